"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; the vector of their bit counts is its embedding. The
Manhattan distance of two embeddings never exceeds the Hamming distance, so pairs within the limit lie close on the
grid: with limit 4 and eight groups of four segments, at least four groups have equal counts. Each choice of four
groups is a grid of cells; fingerprints that share a cell are compared, first by Manhattan distance and then exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, stored, texts
from .components import connected_components

GROUPS = 8
#: Cells with more fingerprints than this are split by the fingerprints' own bits before pairs are compared.
CELL = 16384
#: Cells up to this size compare all their pairs, many cells at a time; larger ones go by pivots.
SMALL = 64


def shingles(text: bytes, k: int) -> list[bytes]:
    words = text.translate(LOWER_ASCII).split()
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    whole = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[: -k] + 1))
    return [whole[a:b] for a, b in zip(starts.tolist(), stops[k - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, k)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(parts), 4096):
        h = np.array([xxh64_intdigest(p, seed) for p in parts[lo : lo + 4096]], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(parts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0]) if parts else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.array([fingerprint(x, k, seed) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], names=["doc_id", "body", "fp"])


def fingerprints(docs: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, body (a hash of the text) and fp (the 64 bits as a signed long) for each row."""
    return texts(docs).withColumn("body", F.xxhash64("text")).mapInArrow(partial(_fingerprints, k=k, seed=seed), "doc_id long, body long, fp long")


def _thermometer(f: np.ndarray) -> np.ndarray:
    """Counts 0, 1, 2 of each two-bit segment as 00, 01, 11, so that Manhattan distance is the number of differing bits."""
    low, high = f & np.uint64(0x5555555555555555), (f >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | ((low & high) << np.uint64(1))


def masks(limit: int) -> list[int]:
    """A mask over the embedding's bits for each choice of the GROUPS - limit groups that must agree."""
    group = lambda g: 0xFF << (8 * g)
    return [sum(map(group, some)) for some in combinations(range(GROUPS), GROUPS - limit)]


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _near(f: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs are within the limit: Manhattan distance first, Hamming distance of what it leaves."""
    near = np.bitwise_count(t[i] ^ t[j]) <= limit
    near[near] = np.bitwise_count(f[i[near]] ^ f[j[near]]) <= limit
    return near


def _linked_cells(cell: np.ndarray, f: np.ndarray, limit: int, forest: _Forest, split: bool = True) -> None:
    """Links fingerprints (grouped by cell, each once in a cell) within the limit; keeps a spanning forest of them."""
    t = _thermometer(f)
    ends = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
    sizes = np.diff(np.concatenate(([0], ends)))
    left = np.repeat(ends, sizes) - np.arange(len(cell)) - 1  # fingerprints after each in its cell
    left[np.repeat(sizes > SMALL, sizes)] = 0
    for k in np.flatnonzero(sizes > SMALL):
        some = slice(ends[k] - sizes[k], ends[k])
        if split and sizes[k] > CELL:
            _split_cell(f[some], limit, forest)
        else:
            _dense_cell(f[some], t[some], limit, forest)
    at, step = np.flatnonzero(left > 0), 1
    while len(at):
        near = _near(f, t, at, at + step, limit)
        for x, y in zip(f[at[near]].tolist(), f[at[near] + step].tolist(), strict=True):
            forest.link(x, y)
        step += 1
        at = at[left[at] >= step]


def _dense_cell(f: np.ndarray, t: np.ndarray, limit: int, forest: _Forest) -> None:
    """Links a large cell by pivots: what lies within the limit of a pivot is one component, so only links from it to what lies
    outside, and within twice the limit of the pivot, are sought, and each outer fingerprint needs just one of them."""
    while len(f) > 1:
        apart = np.bitwise_count(f ^ f[0])
        near = (np.bitwise_count(t ^ t[0]) <= limit) & (apart <= limit)
        for x in f[near].tolist()[1:]:
            forest.link(int(f[0]), x)
        outer = np.flatnonzero(~near & (apart <= 2 * limit))
        for i in np.flatnonzero(near)[1:].tolist():
            if not len(outer):
                break
            met = (np.bitwise_count(t[outer] ^ t[i]) <= limit) & (np.bitwise_count(f[outer] ^ f[i]) <= limit)
            for x in f[outer[met]].tolist():
                forest.link(int(f[i]), x)
            outer = outer[~met]
        f, t = f[~near], t[~near]


def _split_cell(f: np.ndarray, limit: int, forest: _Forest) -> None:
    """A large cell falls apart by the fingerprints' own bits: within the limit, as many whole bytes agree as groups do."""
    for m in masks(limit):
        order = np.argsort(f & np.uint64(m), kind="stable")
        key = (f & np.uint64(m))[order]
        _linked_cells(np.concatenate(([0], np.cumsum(np.diff(key) != 0))), f[order], limit, forest, split=False)


def _cells(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by grid, cell and fingerprint; what remains of the last cell waits for the next batch."""
    forest, held = _Forest(), None
    kept = np.array(masks(limit), np.uint64)
    for b in batches:
        f, grid = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), b.column("grid").to_numpy(zero_copy_only=False).astype(np.int64)
        if held is not None:
            f, grid = np.concatenate((held[0], f)), np.concatenate((held[1], grid))
        if not len(f):
            continue
        key = _thermometer(f) & kept[grid]
        change = np.concatenate(([0], np.cumsum((np.diff(key) != 0) | (np.diff(grid) != 0))))
        last = int(np.searchsorted(change, change[-1]))
        held = (f[last:], grid[last:])
        _linked_cells(change[:last], f[:last], limit, forest)
    if held is not None and len(held[0]):
        _linked_cells(np.zeros(len(held[0]), np.int64), held[0], limit, forest)
    nodes = sorted(forest.up)
    for lo in range(0, len(nodes), 50_000):
        some = nodes[lo : lo + 50_000]
        pair = [np.array(x, np.uint64).view(np.int64) for x in (some, [forest.root(n) for n in some])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["a", "b"])


def near_links(fps: DataFrame, limit: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) within limit bits; a spanning forest for each task, not all pairs."""
    low = F.lit(0x5555555555555555).cast("long")
    lo, hi = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    embedded = fps.select("fp", lo.bitwiseOR(hi).bitwiseOR(F.shiftleft(lo.bitwiseAND(hi), 1)).alias("t"))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks(limit)]
    grids = embedded.select("fp", "t", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("grid", "mask"))
    cells = grids.select("fp", F.col("grid").cast("short").alias("grid"), F.col("t").bitwiseAND(F.col("mask")).alias("cell"))
    return cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp").select("fp", "grid").mapInArrow(partial(_cells, limit=limit), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, body, fp and component_id (smallest doc_id reachable through fingerprints within limit bits) for each row of docs.

    Equal fingerprints are one node, so copies cost nothing. Null and empty texts have fingerprint 0 and link like
    any other; null ids never name a component unless all its ids are null; repeated rows come out each; an empty
    table gives no rows; other columns are dropped. limit is at most GROUPS - 1.
    """
    prints = stored(fingerprints(docs, k, seed), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = connected_components(near_links(nodes.select("fp"), limit))
    at = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = at.join(at.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "body", "fp", "component_id")


def one_of_each(docs: DataFrame, k: int = 4, limit: int = 4, seed: int = 42) -> DataFrame:
    """The rows of docs whose id names their component, one for each component.

    In a component without any id, one row for each text stays; of equal rows (id and text) one stays. Columns of any
    name come through, as a row is carried as one column.
    """
    told = stored(near_duplicates(docs, k, limit, seed), "near-duplicates")
    gone = stored(told.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), F.col("body").alias("gone_body")).distinct(), "near-duplicates-gone")
    out = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"))
    out = out.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("body") == F.col("gone_body")), "left_anti")
    kept = told.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    if not kept.groupBy("doc_id", "body").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "body"])
    if not kept.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.countDistinct("body").alias("n")).filter("n > 1").isEmpty():
        least = kept.groupBy(F.col("doc_id").alias("least_id")).agg(F.min("body").alias("least"))  # texts under one id that are near each other
        out = out.join(least, F.col("id") == F.col("least_id"), "left").filter(F.col("least").isNull() | (F.col("least") == F.col("body")))
    return out.select("whole.*")
