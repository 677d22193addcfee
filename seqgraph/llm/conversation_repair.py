"""Conversation repair: the cheapest edits that make the roles alternate, least in order among equals.

Rows are read by an automaton of four states (nothing yet, after system, after user, after assistant); a node is a row and a state.
Costs come from a dynamic programme from the end. Arcs on cheapest paths carry an edit's initial: D(elete), I(nsert), K(eep), R(erole).
A node's optimal arcs have different initials, so its least string leaves by one arc: nodes are ranked by their least strings of 1, 2, 4 ...
initials (a pair of ranks, a node's and that of the node its doubled pointer leads to, ranks twice the length), and the path follows the
arcs of least initial and rank, listed by the doubled pointers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

#: A conversation of more rows, or bytes of text, is solved in pieces of at most so many.
ROWS, BYTES = 4096, 8 << 20
#: Rows of the conversations that are solved together.
TOGETHER = 8192
BLANK = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(4)
_FAR = 1 << 40
#: Where an inserted or rerolled row leads from each state; where a kept row of each initial (other, s, u, a) does (4: nowhere).
_ADDED = np.array([USER, USER, ASSISTANT, USER])
_KEPT = np.array([[4, 4, 4, 4], [SYSTEM, 4, 4, 4], [USER, USER, 4, USER], [4, 4, ASSISTANT, 4]])
#: Bits of a row's symbol beside the initial.
TRUNCATED, EMPTY, AGAIN, DROPPED = 4, 8, 16, 32
_ACCEPT = np.array([0, _FAR, _FAR, 0])
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and symbol of each row after damage; dropped rows stay as marks (symbol DROPPED) of their conversation."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("fate", F.crc32(F.concat_ws(":", word("conv_id"), word("turn")).cast("binary")) % 20)
    rows = rows.withColumn("role", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("fate") < 2, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))))
    body, first = F.rtrim("text", F.lit(BLANK)), F.substring("role", 1, 1)
    symbol = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0) + F.when(body == "", EMPTY).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("fate") == 0, DROPPED).otherwise(symbol).alias("symbol"))


def _with_inserts(base: np.ndarray) -> np.ndarray:
    """Costs from the states of a column once rows may be inserted there; going round user and assistant never pays."""
    out = base.copy()
    out[:, USER] = np.minimum(base[:, USER], 2 + base[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(base[:, ASSISTANT], 2 + base[:, USER])
    out[:, :USER] = np.minimum(base[:, :USER], 2 + out[:, USER : USER + 1])
    return out


def _arcs(symbols: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs of deleting, keeping and reroling rows of the symbols, for each state, given the costs (rows x states) behind them."""
    must, late = (symbols & (EMPTY | AGAIN)) > 0, ((symbols & TRUNCATED) > 0).astype(np.int64)
    more = np.where(must, _FAR, late)[:, None]
    wide = np.concatenate((after, np.full((len(after), 1), _FAR)), axis=1)
    keep = np.take_along_axis(wide, _KEPT[symbols & 3], axis=1) + more
    return np.minimum(after + 3, _FAR), np.minimum(keep, _FAR), np.minimum(after[:, _ADDED] + 2 + more, _FAR)


class Repairs:
    """Cheapest paths through sequences of symbols; end: costs of the states after each sequence. closed: rows may be inserted at the end too."""

    def __init__(self, sequences: list[np.ndarray], end: np.ndarray, closed: bool = True):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # column 0 of each
        columns = int((sizes + 1).sum())
        self.symbols = np.zeros(columns, np.int64)
        self.is_end = np.zeros(columns, bool)
        self.is_end[self.first + sizes] = True
        if sizes.sum():
            self.symbols[~self.is_end] = np.concatenate(sequences)
        self.cost = np.full((columns, 4), _FAR)
        end = np.asarray(end, np.int64)
        self.cost[self.first + sizes] = np.minimum(_with_inserts(end), _FAR) if closed else end
        order = np.argsort(-sizes, kind="stable")
        for back in range(1, int(sizes.max(initial=0)) + 1):
            order = order[: np.searchsorted(-sizes[order], -back, side="right")]
            at = (self.first + sizes)[order] - back
            delete, keep, rerole = _arcs(self.symbols[at], self.cost[at + 1])
            self.cost[at] = _with_inserts(np.minimum(np.minimum(delete, keep), rerole))
        self.cost = np.minimum(self.cost, _FAR)
        self._rank(sizes, end, closed)

    def _rank(self, sizes: np.ndarray, end: np.ndarray, closed: bool) -> None:
        columns = len(self.cost)
        node = np.arange(4 * columns).reshape(columns, 4)
        behind = np.concatenate((node[1:], node[-1:]))  # of the next column
        delete, keep, rerole = _arcs(self.symbols, np.concatenate((self.cost[1:], self.cost[-1:])))
        wide = np.concatenate((behind, node[:, :1]), axis=1)
        target = np.stack((behind, node[:, _ADDED], np.take_along_axis(wide, _KEPT[self.symbols & 3], axis=1), behind[:, _ADDED]), axis=2)
        best = np.stack((delete, self.cost[:, _ADDED] + 2, keep, rerole), axis=2) == self.cost[:, :, None]
        best[self.is_end] &= np.array([False, closed, False, False])
        stops = np.zeros((columns, 4), bool)
        stops[self.first + sizes] = (end == self.cost[self.first + sizes]) | (not closed)
        best &= ((self.cost < _FAR) & ~stops)[:, :, None]
        best, target = best.reshape(-1, 4), target.reshape(-1, 4)
        ends = ~best.any(axis=1)
        initial, own = np.where(ends, 0, 1 + best.argmax(axis=1)), np.arange(4 * columns)
        to = np.where(ends, own, target[own, initial - 1])
        rank, length, most = initial, 1, 3 * int(sizes.max(initial=0)) + 4
        while length < most:
            rank = np.unique(rank * (4 * columns + 1) + rank[to], return_inverse=True)[1]
            to, length = to[to], 2 * length
        # of the optimal arcs, the one of least initial and then of least rank behind it
        weight = np.where(best, np.arange(4) * (4 * columns + 1) + rank[target], np.iinfo(np.int64).max)
        self.label = np.where(ends, -1, weight.argmin(axis=1))
        step = np.where(ends, own, target[own, self.label])
        self.steps, self.jumps = (self.label >= 0).astype(np.int64), [step]
        while (self.label[step] >= 0).any():
            self.steps = self.steps + self.steps[step]
            step = step[step]
            self.jumps.append(step)

    def paths(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of the least paths from the given nodes, one path after the other, where each begins (and the last ends), and the node each ends in."""
        n = self.steps[starts]
        begins = np.concatenate(([0], np.cumsum(n)))
        at, nodes = np.arange(begins[-1]) - np.repeat(begins[:-1], n), np.repeat(starts, n)
        for k, jump in enumerate(self.jumps):
            odd = (at >> k) & 1 == 1
            nodes[odd] = jump[nodes[odd]]
        return nodes, begins, self.jumps[-1][starts]

    def edits(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For nodes of a path: column, edit and the state the edit leads to."""
        return nodes // 4, self.label[nodes], self.jumps[0][nodes] % 4


def _audit(labels: np.ndarray) -> str:
    return np.frombuffer(INITIALS.encode(), np.uint8)[labels].tobytes().decode()


def _lines(columns: list[int], labels: list[int], states: list[int], roles: list[str], texts: list[str]) -> list[str]:
    """Repaired rows; columns count from the first row."""
    out = []
    for c, e, s in zip(columns, labels, states, strict=True):
        if e == KEEP:
            out.append(f"{roles[c]}:{texts[c]}")
        elif e != DELETE:
            out.append(f"{_NAMES[s]}:{texts[c] if e == REROLE else ''}")
    return out


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[1, 2] = _LEGAL[2, 3] = _LEGAL[3, 2] = True
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_repaired long"
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _results(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, [f.split()[0] for f in _OUT.split(", ")], _TYPES)


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else min(most - least + 1 - distinct, (1 << 63) - 1)


def _faults(symbols: np.ndarray) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated rows by first fault, and illegal neighbours."""
    empty, again = (symbols & EMPTY) > 0, (symbols & AGAIN) > 0
    late = ((symbols & TRUNCATED) > 0) & ~empty & ~again
    role = symbols & 3
    return int(empty.sum()), int((again & ~empty).sum()), int(late.sum()), int((~_LEGAL[role[:-1], role[1:]]).sum())


def _solved(held: list[tuple]) -> list[tuple]:
    """held: conv_id, turns, roles, texts, symbols of whole conversations."""
    sequences = [np.array(h[4], np.int64) for h in held]
    repairs = Repairs(sequences, np.tile(_ACCEPT, (len(held), 1)))
    starts = 4 * repairs.first
    nodes, begins, _ = repairs.paths(starts)
    column, label, state = repairs.edits(nodes)
    out = []
    for k, (conv, turns, roles, texts, _) in enumerate(held):
        part = slice(begins[k], begins[k + 1])
        lines = _lines((column[part] - repairs.first[k]).tolist(), label[part].tolist(), state[part].tolist(), roles, texts)
        known = [t for t in turns if t is not None]
        gaps = _gaps(min(known, default=None), max(known, default=None), len(set(known)))
        out.append((conv, gaps, *_faults(sequences[k]), int(repairs.cost[repairs.first[k], START]), _audit(label[part]), hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines)))
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, turn, role and text."""
    held, waiting, seen = [], 0, set()
    for b in batches:
        for conv, turn, role, text, symbol in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if not held or held[-1][0] != conv:
                if waiting >= TOGETHER:
                    yield _results(_solved(held))
                    held, waiting = [], 0
                held.append((conv, [], [], [], []))
                seen = set()
            if symbol & DROPPED:
                continue
            waiting += 1
            again = (role, text) in seen
            seen.add((role, text))
            for values, x in zip(held[-1][1:], (turn, role, text, symbol | AGAIN * again), strict=True):
                values.append(x)
    if held:
        yield _results(_solved(held))


_PIECE = "conv_id long, piece long, turns array<long>, roles array<string>, texts array<string>, symbols array<int>, costs array<long>"


def _cut(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, symbol, again, copies) of large conversations to pieces, each with its costs from state to state."""
    part, k, held, size = TaskContext.get().partitionId(), 0, None, 0
    names, types = [f.split()[0] for f in _PIECE.split(", ")], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def told() -> pa.RecordBatch:
        sequence = np.array(held[4], np.int64)
        ends = np.where(np.eye(4, dtype=bool), 0, _FAR)
        costs = Repairs([sequence] * 4, ends, closed=False)
        return _batch([(held[0], (part << 32) + k, *held[1:], costs.cost[costs.first].ravel().tolist())], names, types)  # costs[exit][entry]

    for b in batches:
        for conv, turn, role, text, symbol, again, copies in zip(*[c.to_pylist() for c in b.columns], strict=True):
            for i in range(copies):
                if held is not None and (held[0] != conv or len(held[1]) >= most_rows or size > most_bytes):
                    yield told()
                    held, k = None, k + 1
                if held is None:
                    held, size = (conv, [], [], [], []), 0
                size += len(text)
                for values, x in zip(held[1:], (turn, role, text, symbol | AGAIN * (again or i > 0)), strict=True):
                    values.append(x)
    if held is not None:
        yield told()


def _ends(pieces: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each piece of one conversation, from the last to the first: four numbers a piece."""
    pieces = pieces.sort_values("piece")
    behind, out = _with_inserts(_ACCEPT[None])[0], []
    for costs in reversed(pieces["costs"].tolist()):
        out.append(behind)
        behind = np.minimum((np.asarray(costs).reshape(4, 4) + behind[:, None]).min(axis=0), _FAR)
    return pd.DataFrame({"piece": pieces["piece"], "behind": [x.tolist() for x in reversed(out)], "cost": int(behind[START])})


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, piece, symbols, behind: for each state that a piece may be entered in, the state its least path leaves it in."""
    for b in batches:
        for conv, piece, symbols, behind in zip(*[c.to_pylist() for c in b.columns], strict=True):
            repairs = Repairs([np.array(symbols, np.int64)], np.array([behind]), closed=False)
            yield _batch([(conv, piece, (repairs.paths(np.arange(4))[2] % 4).tolist())], ["conv_id", "piece", "leaves"], [pa.int64(), pa.int64(), pa.list_(pa.int32())])


def _entries(pieces: pd.DataFrame) -> pd.DataFrame:
    """The state each piece of one conversation is entered in; and the one after the last, where rows may still be inserted."""
    pieces = pieces.sort_values("piece")
    state, out = START, []
    for leaves in pieces["leaves"]:
        out.append(state)
        state = int(leaves[state])
    return pd.DataFrame({"piece": pieces["piece"], "entry": np.array(out, np.int32), "final": np.array([-1] * (len(out) - 1) + [state], np.int32)})


_REPAIRED = "conv_id long, piece long, cost long, audit string, lines binary, n_lines long, faults array<long>, turns array<long>, ends array<int>"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, piece, cost, turns, roles, texts, symbols, behind, entry, final: audit and repaired rows of each piece."""
    names, types = [f.split()[0] for f in _REPAIRED.split(", ")], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    for b in batches:
        for conv, piece, cost, turns, roles, texts, symbols, behind, entry, final in zip(*[c.to_pylist() for c in b.columns], strict=True):
            symbols = np.array(symbols, np.int64)
            repairs = Repairs([symbols], np.array([behind]), closed=False)
            column, label, state = repairs.edits(repairs.paths(np.array([entry]))[0])
            audit, lines = _audit(label), _lines(column.tolist(), label.tolist(), state.tolist(), roles, texts)
            if final >= 0:
                tail = Repairs([np.zeros(0, np.int64)], _ACCEPT[None])
                _, label, state = tail.edits(tail.paths(np.array([final]))[0])
                audit, lines = audit + _audit(label), lines + [f"{_NAMES[s]}:" for s in state.tolist()]
            known = [t for t in turns if t is not None]
            span = [min(known), max(known), len(set(known))] if known else [None, None, 0]
            yield _batch([(conv, piece, cost, audit, "\n".join(lines).encode(), len(lines), list(_faults(symbols)), span, [int(symbols[0] & 3), int(symbols[-1] & 3)])], names, types)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order: sums of what they count, what stands between two of them, and the running hash of their rows."""
    conv, now = None, None

    def told() -> pa.RecordBatch:
        return _results([(conv, _gaps(now["least"], now["most"], now["distinct"]), *now["faults"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest(), now["n"])])

    for b in batches:
        for key, _, cost, audit, lines, n, faults, (least, most, distinct), ends in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if now is None or key != conv:
                if now is not None:
                    yield told()
                conv, now = key, {"least": None, "most": None, "distinct": 0, "faults": [0] * 4, "cost": cost, "audit": [], "sha": hashlib.sha256(), "n": 0, "role": None}
            if now["role"] is not None and not _LEGAL[now["role"], ends[0]]:
                now["faults"][3] += 1
            now["faults"] = [x + y for x, y in zip(now["faults"], faults, strict=True)]
            if least is not None:
                now["distinct"] += distinct - (now["most"] == least)
                now["least"], now["most"] = least if now["least"] is None else now["least"], most
            if n:
                now["sha"].update((b"\n" if now["n"] else b"") + lines)
            now["n"], now["role"] = now["n"] + n, ends[1]
            now["audit"].append(audit)
    if now is not None:
        yield told()


def _repair_large(rows: DataFrame, ids: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Conversations of any size, dealt out by ranges of their rows.

    Equal rows are counted first. A piece's costs from state to state are enough to know the costs behind each piece, those to
    know its least paths, those to know where they leave it. Only numbers (16, then 4 a piece) of a conversation meet in one task; its repaired rows do where
    they are hashed, which SHA-256 allows in order alone, and stream through it a piece at a time.
    """
    rows = rows.filter(F.col("symbol") != DROPPED).groupBy("conv_id", "turn", "role", "text", "symbol").agg(F.count("*").cast("int").alias("copies"))
    rows = stored(rows.withColumn("body", F.sha2("text", 256)), "conversation-rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("body").alias("b")).agg(F.min(order).alias("first"))
    marked = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("body") == F.col("b")))
    marked = marked.select("conv_id", "turn", "role", "text", "symbol", (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("again"), "copies")
    keys = ("conv_id", "turn", "role", "text")
    pieces = stored(marked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_cut, most_rows=most_rows, most_bytes=most_bytes), _PIECE), "conversation-pieces")
    ends = stored(pieces.select("conv_id", "piece", "costs").groupBy("conv_id").applyInPandas(_ends, "piece long, behind array<long>, cost long"), "conversation-ends")
    ways = pieces.select("conv_id", "piece", "symbols").join(ends.drop("cost"), "piece").select("conv_id", "piece", "symbols", "behind").mapInArrow(_ways, "conv_id long, piece long, leaves array<int>")
    entries = ways.groupBy("conv_id").applyInPandas(_entries, "piece long, entry int, final int")
    whole = pieces.drop("costs").join(ends, "piece").join(entries, "piece").select("conv_id", "piece", "cost", "turns", "roles", "texts", "symbols", "behind", "entry", "final")
    repaired = whole.mapInArrow(_repaired, _REPAIRED).repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_joined, _OUT)
    found = ids.select(F.col("conv_id").alias("c")).join(repaired, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return found.select(F.col("c").alias("conv_id"), *[F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in repaired.columns if c != "conv_id"])


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, n_repaired for each conv_id of damage()'s rows.

    Rows go by turn (nulls first), then role and text; a null conv_id is a conversation too; equal rows beyond the first are duplicates.
    Role initials are first characters as they are (any but s, u, a fit nowhere and are never kept). A conversation without rows gets zeros, an
    empty audit and the hash of nothing; gaps beyond a long are held at its largest. An empty table gives no rows.

    A conversation of at most most_rows rows and most_bytes of text is solved whole, in the task that its id is dealt to; larger ones in pieces.
    """
    small_batches(rows.sparkSession)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = stored(sizes.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("large_id")), "conversations-large")
    is_large = F.col("conv_id").eqNullSafe(F.col("large_id"))
    small = rows.join(large, is_large, "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_whole, _OUT)
    if large.isEmpty():
        return small
    return small.unionByName(_repair_large(rows.join(large, is_large, "left_semi"), large.select(F.col("large_id").alias("conv_id")), most_rows, most_bytes))


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """repair() of damage(); other columns are dropped."""
    return repair(damage(conversations))
