"""Nearest vectors by cosine: exactly, in blocks, and by an index of cells.

Vectors are packed to blocks of bounded size, so a large model or cell is many blocks and no task holds it. Exactly: each block of queries meets
each block of its model. By the index: centroids are fitted to a bounded sample; every row lies in the cell of its nearest centroid, and a query looks
into so many of its nearest cells as the sample needs for the recall asked for. What is found is ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Components of a block.
CELLS = 1 << 18
#: Rows that an index is fitted to, and how many a cell of it should have of them.
SAMPLE, PER_CELL = 20_000, 64
_BLOCK = "model long, cell int, block long, n int, ids array<long>, matrix binary"


def _unit(b: pa.RecordBatch) -> np.ndarray:
    """Rows of unit length (zero vectors stay); all vectors have as many components."""
    x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n cells with the largest product, nearest first; ties to the smaller number."""
    return np.argsort(-np.round(x @ centroids.T, 12), axis=1, kind="stable")[:, :n]


def _celled(batches: Iterator[pa.RecordBatch], centroids: np.ndarray | None, probes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        at = np.zeros((b.num_rows, 1), np.int64) if centroids is None else _nearest_cells(_unit(b), centroids, probes)
        take = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("id", "model", "vec")), pa.array(at.ravel().astype(np.int32))], names=["id", "model", "vec", "cell"])


def _packed(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by model and cell, to blocks."""
    part, k, held, size, key = TaskContext.get().partitionId(), 0, [], 0, None

    def told() -> pa.RecordBatch:
        x, ids = np.concatenate([h[1] for h in held]), [i for h in held for i in h[0]]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([(part << 32) + k]), pa.array([len(ids)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()])], names=["model", "cell", "block", "n", "ids", "matrix"])

    for b in batches:
        if not b.num_rows:
            continue
        x, keys, ids = _unit(b), list(zip(b.column("model").to_pylist(), b.column("cell").to_pylist(), strict=True)), b.column("id").to_pylist()
        lo = 0
        while lo < len(keys):
            if held and (keys[lo] != key or size >= cells):
                yield told()
                held, size, k = [], 0, k + 1
            key = keys[lo]
            most = min(len(keys), lo + max(1, (cells - size) // max(1, x.shape[1])))
            hi = next((i for i in range(lo, most) if keys[i] != key), most)
            held.append((ids[lo:hi], x[lo:hi]))
            size += (hi - lo) * max(1, x.shape[1])
            lo = hi
    if held:
        yield told()


def blocks(vectors: DataFrame, centroids: np.ndarray | None = None, probes: int = 1, cells: int = CELLS) -> DataFrame:
    """vectors (id, model, vec: as many components each; nulls don't count) as blocks of each model and cell; a row is in its probes nearest cells."""
    rows = vectors.filter("id IS NOT NULL AND model IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("model").cast("long").alias("model"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.mapInArrow(partial(_celled, centroids=centroids, probes=probes), "id long, model long, vec array<double>, cell int").withColumn("at", F.xxhash64("id"))
    return rows.repartitionByRange("model", "cell", "at").sortWithinPartitions("model", "cell", "at").drop("at").mapInArrow(partial(_packed, cells=cells), _BLOCK)


def _met(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: for each query its k best rows of the other block, itself excluded."""
    for b in batches:
        for q_ids, q, ids, x in zip(*[b.column(c) for c in ("q_ids", "q_matrix", "ids", "matrix")], strict=True):
            q_ids, ids = np.array(q_ids.as_py(), np.int64), np.array(ids.as_py(), np.int64)
            x = np.frombuffer(x.as_py(), np.float64).reshape(len(ids), -1)
            q = np.frombuffer(q.as_py(), np.float64).reshape(len(q_ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, scores = ids[order], np.round(q @ x[order].T, 9)
            scores[q_ids[:, None] == ids[None, :]] = -np.inf
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(scores, best, axis=1)
            stay = found > -np.inf
            row = np.repeat(np.arange(len(q_ids)), stay.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[best[stay]]), pa.array(found[stay])], names=["query", "id", "cosine"])


def search(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """query, id, cosine (nine places), rank: the k nearest rows of each query, from blocks() of both that share model and cell."""
    q = queries.select("model", "cell", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    near = q.join(rows, ["model", "cell"]).select("q_ids", "q_matrix", "ids", "matrix").mapInArrow(partial(_met, k=k), "query long, id long, cosine double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)


def exact(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int = CELLS) -> DataFrame:
    """The k nearest of all rows of a query's model: every block against every block of it."""
    return search(blocks(queries, cells=cells), blocks(vectors, cells=cells), k)


@dataclass(frozen=True)
class Index:
    """Centroids, and how many cells a query looks into."""

    centroids: np.ndarray
    probes: int


def fit_index(vectors: DataFrame, recall: float = 0.95, k: int = 10, sample: int = SAMPLE, rounds: int = 10, seed: int = 7) -> Index:
    """Centroids of a sample (those with the least hash of their id, at most sample rows) by spherical k-means; probes: the least number with
    which sampled queries find that share of their k nearest in the sample."""
    rows = vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not rows.num_rows:
        return Index(np.zeros((1, 0)), 1)
    x = _unit(rows.combine_chunks().to_batches()[0])
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), max(1, len(x) // PER_CELL), replace=False)]
    for _ in range(rounds):
        at = _nearest_cells(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, np.divide(total, norm, out=np.zeros_like(total), where=norm > 0), c)
    own = _nearest_cells(x, c, 1)[:, 0]
    asked = rng.choice(len(x), min(len(x), 500), replace=False)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(_nearest_cells(x[asked], c, len(c)), axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Index(c, 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else 1)


def indexed(index: Index, vectors: DataFrame, cells: int = CELLS) -> DataFrame:
    """All rows, in the blocks of their cells."""
    return blocks(vectors, index.centroids, 1, cells)


def approximate(index: Index, queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows (of indexed()) that lie in a query's nearest cells."""
    return search(blocks(queries, index.centroids, min(index.probes, len(index.centroids))), rows, k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row: recall (share of the true pairs that were found), pairs."""
    hit = true.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"), F.count(F.lit(1)).alias("pairs"))
