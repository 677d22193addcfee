"""Hard-negative mining by the threshold algorithm.

Rows are dealt to shards of bounded size; each holds, for every dimension, its rows in ascending order of their component.
For an anchor the lists are read from the top where its component is positive and from the bottom where it is negative; rows met are scored
by random access, as integers. What no list has shown yet scores at most the threshold: the anchor's product with the components at the
depth reached. An anchor leaves a shard once that is strictly below the k-th score of each of its windows (or below the window, if it isn't full).
Depth grows by steps, while the lists' heads together are at most half of the shard; an anchor that isn't done then has all rows of it scored.
Best rows are carried from shard to shard within a task, so later shards end sooner, many before any access.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_path, small_batches, stored

#: Components of a shard, and anchors (and their components) that are sought at a time: what a task holds of either.
CELLS, ANCHORS, ANCHOR_CELLS = 1 << 18, 1 << 15, 1 << 21
#: Scores of a shard that are held at a time.
SCORES = 1 << 21
#: Integer components are held at this, so that scores fit a long (for up to 8,192 dimensions).
LARGEST = 1 << 24
_NEVER, _ALWAYS = -(1 << 62), 1 << 62


def integer_rows(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, x (array of int: floor of 256 times each component) of the rows that take part; label of each every-th id is moved on by one."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("label").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    whole = F.transform(x, lambda v: F.greatest(F.least(F.floor(v * F.lit(256.0)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)
    return embeddings.filter(usable).select(vec_id.alias("vec_id"), moved.alias("label"), whole.alias("x"))


_SHARD = "shard long, ids array<long>, labels array<long>, dims int, cells binary, lists binary"


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Rows of integers; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    dims = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dims), np.int32)
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _shards(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, x) to shards, in the order in which they come."""
    part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

    def told() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        x = _padded(rows.column("x").chunk(0)) if rows.num_rows else np.zeros((0, 0), np.int32)
        lists = np.argsort(x.T, axis=1, kind="stable").astype(np.uint16)
        one = [[(part << 32) + k], [rows.column("vec_id").to_pylist()], [rows.column("label").to_pylist()], [x.shape[1]], [x.tobytes()], [lists.tobytes()]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, types, strict=True)], names=["shard", "ids", "labels", "dims", "cells", "lists"])

    for b in batches:
        lo = 0
        while lo < b.num_rows:
            dims = max(1, len(b.column("x")[lo]))
            n = min(b.num_rows - lo, max(1, (cells - size) // dims), 4096)
            held.append(b.slice(lo, n))
            size += max(n, pc.sum(pc.list_value_length(held[-1].column("x"))).as_py())
            lo += n
            if size >= cells:
                yield told()
                held, size, k = [], 0, k + 1
    if held:
        yield told()


class Shard:
    """One shard, unpacked."""

    def __init__(self, shard: int, ids: list, labels: list, dims: int, cells: bytes, lists: bytes):
        self.shard, self.n, self.dims = shard, len(ids), dims
        self.known = np.array([i is not None for i in ids], bool)
        self.ids, self.labels = np.array([i or 0 for i in ids], np.int64), np.array(labels, np.int64)
        self.x = np.frombuffer(cells, np.int32).reshape(self.n, dims)
        self.lists = np.frombuffer(lists, np.uint16).reshape(dims, self.n)
        self.largest = int(np.abs(self.x).max(initial=0))
        self.longest = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(1).max(initial=0)))

    def typed(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both sides in a type in which inner products are exact integers, with as many dimensions."""
        dims = max(self.dims, anchors.shape[1])
        bound = self.largest * int(np.abs(anchors).max(initial=0)) * max(1, min(self.dims, anchors.shape[1]))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return tuple(np.pad(m, ((0, 0), (0, dims - m.shape[1]))).astype(kind) for m in (anchors, self.x))

    def heads(self, depth: int, signs: np.ndarray) -> np.ndarray:
        """Rows in the first depth places of each dimension's list, read from the end that suits the sign."""
        seen = np.zeros(self.n, bool)
        seen[self.lists[signs > 0, self.n - depth :]] = True
        seen[self.lists[signs < 0, :depth]] = True
        return seen

    def thresholds(self, anchors: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
        """The largest score that a row outside the heads can have, for each anchor. Heads of depth 0 are empty."""
        if depth >= self.n:
            return np.full(len(anchors), _NEVER)
        d = np.arange(self.dims)
        top, low = x[self.lists[:, self.n - 1 - depth], d], x[self.lists[:, depth], d]
        a = anchors[:, : self.dims]
        return (np.maximum(a, 0) @ top + np.minimum(a, 0) @ low).astype(np.int64)


class Best:
    """The k best rows of each group: by score, larger first, then by id, nulls last."""

    def __init__(self, groups: int, k: int):
        self.groups, self.k = groups, k
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.known = np.zeros(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, id_: np.ndarray, known: np.ndarray) -> None:
        g, s, i, n = (np.concatenate(p) for p in ((self.group, group), (self.score, score), (self.id, id_), (self.known, known)))
        order = np.lexsort((i, ~n, -s, g))
        g = g[order]
        rank = np.arange(len(g)) - np.searchsorted(g, g)
        order = order[rank < self.k]
        self.group, self.score, self.id, self.known = (np.concatenate(p)[order] for p in ((self.group, group), (self.score, score), (self.id, id_), (self.known, known)))

    def kth(self) -> np.ndarray:
        """The k-th score of each group that has so many; _NEVER of the others."""
        out = np.full(self.groups, _NEVER)
        last = np.searchsorted(self.group, np.arange(self.groups), side="left") + self.k - 1
        full = np.flatnonzero(np.bincount(self.group, minlength=self.groups) >= self.k)
        out[full] = self.score[last[full]]
        return out


class Seek:
    """Anchors with their windows: a row of group anchor * windows + w must score from low to high; only (not) of the anchor's label."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, shards: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.x, self.labels, self.shards, self.ids, self.low, self.high, self.same = x, labels, shards, ids, low, high, same
        self.best = Best(low.size, k)

    def bars(self, anchor: int | slice = slice(None)) -> np.ndarray:
        """For each window the score below which no row helps any more."""
        kth, low, high = self.best.kth().reshape(self.low.shape)[anchor], self.low[anchor], self.high[anchor]
        return np.maximum(kth, np.where(low > high, _ALWAYS, low))

    def visit(self, shard: Shard) -> int:
        """Takes in what the shard has for each anchor; how many rows were scored."""
        if not shard.n:
            return 0
        bars = self.bars().min(axis=1)
        asked = np.isin(self.labels, shard.labels) if self.same else ~np.isin(self.labels, shard.labels[:1]) | (shard.labels != shard.labels[0]).any()
        scored, some = 0, np.flatnonzero(asked & (bars < _ALWAYS))
        step = max(1, SCORES // shard.n)
        for lo in range(0, len(some), step):
            scored += self._visit(shard, some[lo : lo + step], bars)
        return scored

    def _visit(self, shard: Shard, at: np.ndarray, bars: np.ndarray) -> int:
        a, x = shard.typed(self.x[at])
        stay = shard.thresholds(a, x, 0) >= bars[at]  # the others leave before any access
        at, a = at[stay], a[stay]
        depths = [d for d in (1 << k for k in range(1, 17, 2)) if 2 * d * max(1, shard.dims) <= shard.n]
        scored, rest = 0, np.ones(len(at), bool)
        if depths and len(at):
            reach = np.minimum(self.high[at].max(axis=1), np.ceil(np.sqrt((a.astype(np.float64) ** 2).sum(1)) * shard.longest) + 1)  # no k-th score is above
            for i in np.flatnonzero(shard.thresholds(a, x, depths[-1]) < reach):
                scored += self._step_by_step(shard, int(at[i]), a[i], x, depths)
                rest[i] = False
        at, a = at[rest], a[rest]
        if len(at):
            scores = a @ x.T
            least = bars[at][:, None] if scores.dtype == np.int64 else bars[at].astype(np.float64)[:, None]
            if (bars[at] == _NEVER).any() and shard.n > self.best.k + 1:  # its own k + 1 best (one may be the anchor) bound the rest
                fit = (self.labels[at][:, None] == shard.labels[None, :]) == self.same
                own = np.partition(np.where(fit, scores, -np.inf if scores.dtype != np.int64 else _NEVER), -self.best.k - 1, axis=1)[:, -self.best.k - 1]
                least = np.maximum(least, own[:, None])
            r, c = np.nonzero(scores >= least)
            self._take(shard, at[r], c, scores[r, c].astype(np.int64))
            scored += scores.size
        return scored

    def _step_by_step(self, shard: Shard, anchor: int, a: np.ndarray, x: np.ndarray, depths: list[int]) -> int:
        """One anchor, deeper and deeper, at last all rows; how many were scored."""
        seen, signs = np.zeros(shard.n, bool), a[: shard.dims]
        for depth in (*depths, shard.n):
            new = np.flatnonzero(shard.heads(depth, signs) & ~seen if depth < shard.n else ~seen)
            seen[new] = True
            self._take(shard, np.full(len(new), anchor), new, (x[new] @ a).astype(np.int64))
            if depth < shard.n and shard.thresholds(a[None], x, depth)[0] < self.bars(anchor).min():
                break
        return int(seen.sum())

    def _take(self, shard: Shard, anchor: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        fits = (self.labels[anchor] == shard.labels[row]) == self.same
        if self.same:
            fits &= ~((self.shards[anchor, 0] == shard.shard) & (self.shards[anchor, 1] == row))
        anchor, row, score = anchor[fits], row[fits], score[fits]
        windows = self.low.shape[1]
        inside = (score[:, None] >= self.low[anchor]) & (score[:, None] <= self.high[anchor])
        r, w = np.nonzero(inside)
        self.best.add(anchor[r] * windows + w, score[r], shard.ids[row[r]], shard.known[row[r]])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for b in batches:
        for row in zip(*[b.column(c) for c in ("shard", "ids", "labels", "dims", "cells", "lists")], strict=True):
            yield Shard(*[v.as_py() for v in row])


_BUNDLE = "shard long, rows array<int>, ids array<long>, labels array<long>, dims int, cells binary"


def _bundles(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """The anchors of each shard, as one row."""
    for s in _unpacked(batches):
        at = np.flatnonzero(s.known & (s.ids % every == 0))
        if len(at):
            one = [[s.shard], [at.tolist()], [s.ids[at].tolist()], [s.labels[at].tolist()], [s.dims], [s.x[at].tobytes()]]
            types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, types, strict=True)], names=["shard", "rows", "ids", "labels", "dims", "cells"])


def _sought(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """block: a broadcast dict of Seek's arguments. anchor, place, score, id of the best rows of this task's shards."""
    seek = Seek(**block.value, k=k)
    for shard in _unpacked(batches):
        seek.visit(shard)
    best, windows = seek.best, seek.low.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(best.group // windows), pa.array(best.group % windows, pa.int32()), pa.array(best.score), pa.array(best.id, mask=~best.known)], names=["anchor", "place", "score", "id"])


def _passes(bundles: DataFrame, anchors: int, cells: int) -> Iterator[dict]:
    """Anchors in blocks of bounded size: x, labels, shards (and row there), ids."""
    held, size, width = [], 0, 0
    for row in bundles.toLocalIterator():
        n = len(row["rows"])
        if held and (size + n > anchors or (size + n) * max(width, row["dims"]) > cells):
            yield _block(held)
            held, size, width = [], 0, 0
        held.append(row)
        size, width = size + n, max(width, row["dims"])
    if held:
        yield _block(held)


def _block(held: list) -> dict:
    width = max(r["dims"] for r in held)
    xs = [np.frombuffer(r["cells"], np.int32).reshape(len(r["rows"]), r["dims"]) for r in held]
    return {
        "x": np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in xs]),
        "labels": np.concatenate([np.array(r["labels"], np.int64) for r in held]),
        "shards": np.concatenate([np.array([[r["shard"], k] for k in r["rows"]], np.int64) for r in held]),
        "ids": np.concatenate([np.array(r["ids"], np.int64) for r in held]),
    }


def _first(found: DataFrame, k: int, *group: str) -> DataFrame:
    ordered = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


_FOUND = "anchor long, place int, score long, id long"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, cells: int = CELLS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, x: array of int).

    Anchors are the rows whose id is a multiple of every; a score is an integer inner product, ties go by smaller id, null ids last (and never
    anchors). An anchor's positives are its best other rows of its label; for each, negatives are the best rows of other labels that score from
    least to most hundredths of the positive's score: none where that is negative. Shorter vectors count as if they ended in zeros.
    Repeated rows are rows of their own: a copy of an anchor is one of its positives. An empty table gives no rows.

    Anchors go in blocks of at most ANCHORS (and ANCHOR_CELLS components), broadcast one after the other; each is sought in all shards, first for positives, then
    for the windows these set. A task sends the best few rows of each window only.
    """
    spark = rows.sparkSession
    small_batches(spark)
    ranged = rows.withColumn("at", F.xxhash64("vec_id", "x")).repartitionByRange("label", "at").sortWithinPartitions("label", "at")
    path = shared_path(spark, "negative-shards")
    ranged.select("vec_id", "label", "x").mapInArrow(partial(_shards, cells=cells), _SHARD).write.options(**{"parquet.block.size": str(8 << 20)}).parquet(path)  # small row groups: a file is many tasks
    shards = spark.read.schema(_SHARD).parquet(path)
    bundles = stored(shards.mapInArrow(partial(_bundles, every=every), _BUNDLE), "negative-anchors")
    told = shared_path(spark, "negatives")
    spark.createDataFrame([], _OUT).write.parquet(told)
    for block in _passes(bundles, anchors, ANCHOR_CELLS):
        n = len(block["ids"])
        free = {"low": np.full((n, 1), _NEVER), "high": np.full((n, 1), _ALWAYS)}
        sent = spark.sparkContext.broadcast(block | free | {"same": True})
        best = _first(shards.mapInArrow(partial(_sought, block=sent, k=positives), _FOUND), positives, "anchor").select("anchor", "rank", "score", "id").toArrow()
        sent.destroy()
        anchor, place, score = (best.column(c).to_numpy() for c in ("anchor", "rank", "score"))
        ids, known = np.zeros((n, positives), np.int64), np.zeros((n, positives), bool)
        low, high = np.ones((n, positives), np.int64), np.zeros((n, positives), np.int64)
        high[anchor, place - 1] = score * most // 100
        low[anchor, place - 1] = -(-score * least // 100)
        score_of = np.zeros((n, positives), np.int64)
        score_of[anchor, place - 1] = score
        ids[anchor, place - 1] = best.column("id").fill_null(0).to_numpy()
        known[anchor, place - 1] = best.column("id").is_valid().to_numpy()
        sent = spark.sparkContext.broadcast(block | {"low": low, "high": high, "same": False})
        found = _first(shards.mapInArrow(partial(_sought, block=sent, k=negatives), _FOUND), negatives, "anchor", "place")
        names = spark.sparkContext.broadcast((block["ids"], ids, known, score_of))
        found.select("anchor", "place", "rank", "score", "id").mapInArrow(partial(_named, names=names), _OUT).write.mode("append").parquet(told)
        sent.destroy()
        names.destroy()
    return spark.read.schema(_OUT).parquet(told)


def _named(batches: Iterator[pa.RecordBatch], names) -> Iterator[pa.RecordBatch]:
    anchor_ids, ids, known, scores = names.value
    for b in batches:
        anchor, place = (b.column(c).to_numpy() for c in ("anchor", "place"))
        columns = [pa.array(anchor_ids[anchor]), pa.array(ids[anchor, place], mask=~known[anchor, place]), b.column("rank"), b.column("id"), pa.array(scores[anchor, place]), b.column("score")]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """mine() over integer_rows(); rows with a null label or vector, or a component that is null or not finite, take no part; other columns are dropped."""
    return mine(integer_rows(embeddings))
