"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model is fitted to them by dual
coordinate descent, and its margin is turned into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bucket, texts

BITS = 18
#: Labelled rows of each class that the model is fitted to, at most (smallest hash of doc_id first).
SAMPLE = 2_500
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
#: Letters become A or a, digits 0, what isn't ASCII a; so the n-grams of shapes see marks, capitals and spacing.
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_REPEAT = bytes([110, 114])


def _grams(text: bytes, n: int, kind: int) -> np.ndarray:
    """Hashes of the n-grams of bytes, apart by kind."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.zeros(0, np.uint32)
    code = np.full(len(b) - n + 1, kind, np.uint64)
    for k in range(n):
        code = (code << np.uint64(8)) | b[k : len(b) - n + 1 + k]
    with np.errstate(over="ignore"):
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.uint32)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct n-gram indicators: three letters, four shapes, and four words' repeat marks (equal to the word before)."""
    words = text.split()
    repeats = bytes(map(eq, words[1:], words)).translate(_REPEAT + bytes(range(2, 256)))
    seen = np.zeros(1 << BITS, bool)
    for grams in (_grams(text.translate(_LOWER), 3, 1), _grams(text.translate(_SHAPE), 4, 2), _grams(repeats, 4, 3)):
        seen[grams] = True
    return np.flatnonzero(seen).astype(np.uint32)


@dataclass
class Model:
    weights: np.ndarray  # for the normalised ratios
    ratios: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        x = self.ratios[ids]
        norm = np.sqrt(x @ x)
        return float(x @ self.weights[ids] / norm if norm else 0.0) + self.bias

    def probability(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -50, 50))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, costs: np.ndarray, size: int, epochs: int = 15, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1 hinge-loss machine: one dual variable at a time, in a new seeded order each epoch."""
    w, bias, alpha, rng = np.zeros(size), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            slack = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _platt(margins: np.ndarray, y: np.ndarray, turns: int = 50) -> tuple[float, float]:
    """Slope and offset of the sigmoid over margins, by Newton's method on Platt's smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    theta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones(len(margins))], 1)
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.linalg.solve(curve, x.T @ (p - target) + 1e-3 * (theta - np.array([1.0, 0.0])))
    return float(theta[0]), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0) -> Model:
    """The model for feature lists and labels 0/1. With one class only (or none) every score is that class's smoothed share."""
    size = 1 << BITS
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    up, down = int((y > 0).sum()), int((y < 0).sum())
    if not up or not down:
        share = (up + 1) / (up + down + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = np.full((2, size), smoothing)
    for ids, label in zip(rows, y, strict=True):
        counts[int(label > 0)][ids] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for ids in rows:
        x = ratios[ids]
        norm = np.sqrt(x @ x)
        values.append(x / norm if norm else x)
    costs = np.where(y > 0, cost * len(y) / (2 * up), cost * len(y) / (2 * down))
    w, bias = dual_coordinate_descent(rows, values, y, costs, size)
    margins = np.array([w[ids] @ v + bias for ids, v in zip(rows, values, strict=True)])
    return Model(w, ratios, bias, *_platt(margins, y))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [features(x).tobytes() for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(ids, pa.binary())], names=["label", "ids"])


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 4, held: int = 2, sample: int = SAMPLE) -> DataFrame:
    """label, text of up to `sample` rows of each class; never of the held-out remainder. Null labels and ids count for nothing;
    a document with several labels has their majority, and none on a tie."""
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & (text_bucket("doc_id", modulus) != held))
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(label_col).alias("a")).filter("a <> 0.5").select("doc_id", (F.col("a") > 0.5).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = told.filter("label = 1").orderBy(*order).limit(sample).unionByName(told.filter("label = 0").orderBy(*order).limit(sample))
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most 2 * sample ids


def train(docs: DataFrame, labels: DataFrame, **how) -> Model:
    got = training_rows(docs, labels, **how).mapInArrow(_features, "label int, ids binary").collect()
    got.sort(key=lambda r: (r["label"], bytes(r["ids"])))
    return fit([np.frombuffer(bytes(r["ids"]), np.uint32) for r in got], np.array([r["label"] for r in got]))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = [model.value.probability(features(x)) for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model, modulus: int = 4, held: int = 2, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for each row; the text alone decides. Null and empty texts have no
    indicators and get the bias's score; repeated rows are scored each; an empty table gives no rows; other columns go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = texts(docs).mapInArrow(partial(_scored, model=shared), "doc_id long, score double")
    return out.select("doc_id", (text_bucket("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
