"""Language-model scores of whole documents, and the unigram base beside them.

Words are counted over all training documents. The most frequent ones are symbols of a gated recurrent model; every
other word is one of a few tail symbols (by its first bytes) times its share of that tail. The model is trained in
tasks that pass once over all training documents, in rounds after each of which the weights are averaged.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, stored, text_bucket, texts
from .gru import Gru

SYMBOLS, TAILS, PER_CLASS = 1024, 64, 32
#: No word has white space in it, so this can stand for the end of a document.
END = b"\n"
#: The pass over all training words has so many rounds, about TASK_WORDS to a file, BATCH pieces of documents side by side.
ROUNDS, TASK_WORDS, BATCH = 3, 3_000_000, 512
#: Words of the documents that are scored together, about: the fewer, the more time goes to the last words of the longest.
SLICE_WORDS = 3_000_000


def words_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER_ASCII).split(), END]


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[:3]) % TAILS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n: Counter[bytes] = Counter()
        for text in b.column("text").cast(pa.binary()).to_pylist():
            n.update(words_of(text))
        words = sorted(n)
        for lo in range(0, len(words), 50_000):
            some = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([n[w] for w in some], pa.int64())], names=["word", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes; END for ends), n over all rows."""
    return train.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Symbols in descending mass: ids of frequent words, ids of the tails, and the totals for the base."""

    heads: dict[bytes, int]
    head_counts: np.ndarray  # by symbol; 0 at tails
    tails: np.ndarray  # symbol of each tail
    tail_words: np.ndarray
    tail_kinds: np.ndarray
    mass: np.ndarray
    total: int
    kinds: int


def vocabulary(counts: DataFrame, symbols: int = SYMBOLS) -> Vocabulary:
    """The most frequent words (a bounded number) come to the driver, and a row for each tail."""
    end = counts.filter(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = counts.filter(F.col("word") != F.lit(END))
    top = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(symbols - TAILS - 1).collect()]
    tail = F.crc32(F.substring("word", 1, 3)) % TAILS
    rest = {r["tail"]: r for r in words.groupBy(tail.alias("tail")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()}
    n, kinds = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for k, r in rest.items():
        n[k], kinds[k] = r["n"], r["kinds"]
    total, all_kinds = int(n.sum()) + end, int(kinds.sum()) + (end > 0)
    for w, c in top:
        n[tail_of(w)] -= c
        kinds[tail_of(w)] -= 1
    names: list[tuple[int, bytes | int]] = [(end, END), *((c, w) for w, c in top), *((int(c), k) for k, c in enumerate(n))]
    names += [(0, b"\n%d" % k) for k in range(symbols - len(names))]  # unused symbols, where there are few words
    names.sort(key=lambda x: -x[0])
    heads = {w: i for i, (_, w) in enumerate(names) if isinstance(w, bytes)}
    tails = np.zeros(TAILS, np.int64)
    for i, (_, w) in enumerate(names):
        if isinstance(w, int):
            tails[w] = i
    mass = np.array([c for c, _ in names], np.float64)
    head_counts = np.array([c if isinstance(w, bytes) else 0 for c, w in names], np.int64)
    return Vocabulary(heads, head_counts, tails, n, kinds, mass, total, all_kinds)


def _symbols(text: bytes, v: Vocabulary) -> np.ndarray:
    get = v.heads.get
    return np.array([s if (s := get(w)) is not None else v.tails[tail_of(w)] for w in words_of(text)], np.int64)


def _encoded(batches: Iterator[pa.RecordBatch], v) -> Iterator[pa.RecordBatch]:
    for b in batches:
        symbols = [_symbols(x, v.value).astype(np.uint16).tobytes() for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("deal"), pa.array(symbols, pa.binary())], names=["deal", "symbols"])


def _trained(batches: Iterator[pa.RecordBatch], weights, first: int, rate: float, turn: int) -> Iterator[pa.RecordBatch]:
    model, moments, seen = pickle.loads(weights.value), [], 0
    for b in batches:
        docs = [np.frombuffer(x, np.uint16) for x in b.column("symbols").to_pylist()]
        seen += model.train(docs, first, rate, batch=BATCH, seed=turn, moments=moments)
    if seen:
        yield _weighed(seen, model.weights())


def _weighed(seen: int, weights: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([pickle.dumps(weights)], pa.binary())], names=["seen", "weights"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a partition: the mean of the weights by words seen."""
    seen, sums = 0, None
    for b in batches:
        for n, raw in zip(b.column("seen").to_pylist(), b.column("weights").to_pylist(), strict=True):
            part = [n * w.astype(np.float64) for w in pickle.loads(raw)]
            seen, sums = seen + n, part if sums is None else [x + y for x, y in zip(sums, part, strict=True)]
    if seen:
        yield _weighed(seen, [w / seen for w in sums])


def train_model(train: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Gru:
    """A model averaged over tasks after each of so many rounds; every training document is learned from in one of them. Documents are
    dealt by a hash, sorted, and streamed through the tasks. The tasks' weights are averaged in Spark first, so the driver gets about the square root of
    their number. No training documents: the untrained model."""
    spark, model = train.sparkSession, Gru(v.mass, per_class=PER_CLASS)
    files = max(2, v.total // TASK_WORDS)
    symbols = train.select("text", F.xxhash64("text", "doc_id").alias("deal")).mapInArrow(partial(_encoded, v=spark.sparkContext.broadcast(v)), "deal long, symbols binary")
    symbols = symbols.withColumn("round", F.pmod(F.shiftright("deal", 8), F.lit(rounds)).cast("int"))
    symbols = stored(symbols.repartition(files, "deal").sortWithinPartitions("round", "deal", "symbols").select("round", "symbols"), "lm-symbols")
    for turn in range(rounds):
        weights = spark.sparkContext.broadcast(pickle.dumps(model))
        part = symbols.filter(F.col("round") == turn).select("symbols")
        got = part.mapInArrow(partial(_trained, weights=weights, first=v.heads[END], rate=0.02 / (1 + turn), turn=turn), "seen long, weights binary")
        got = got.repartition(math.isqrt(files)).mapInArrow(_averaged, "seen long, weights binary").collect()
        if not got:  # no documents in this round
            continue
        seen = sum(r["seen"] for r in got)
        parts = [(r["seen"] / seen, pickle.loads(bytes(r["weights"]))) for r in got]
        model.set_weights([sum(s * p[i] for s, p in parts).astype(np.float32) for i in range(len(Gru.NAMES))])
    return model


def _pack(*arrays: np.ndarray | bytes | list) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


class _Slice:
    """Documents that are scored together. Frequent words have their symbol's number, others are numbered from SYMBOLS as they come."""

    def __init__(self, v: Vocabulary):
        self.index, self.shift = dict(v.heads), SYMBOLS - len(v.heads)
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.sizes: list[int] = []
        self.flat: list[np.ndarray] = []
        self.words = 0

    def add(self, doc: int | None, held: bool, text: bytes) -> None:
        words, index, shift = words_of(text), self.index, self.shift
        self.flat.append(np.array([index.setdefault(w, len(index) + shift) for w in words], np.int32))
        self.ids.append(doc)
        self.held.append(held)
        self.sizes.append(len(words))
        self.words += len(words)

    def rows(self, name: str, model: Gru, v: Vocabulary, shards: int) -> pa.RecordBatch:
        """What the model and the frequent words give the documents (kept whole), and the tail words by shard."""
        log_head = np.log10(v.head_counts + 0.5)
        log_tail = np.log10(v.tail_words + 0.5 * (v.tail_kinds + 1))
        ids, sizes, held = np.concatenate(self.flat), np.array(self.sizes), np.array(self.held)
        starts, n = np.concatenate(([0], np.cumsum(sizes))), len(sizes)
        new = list(self.index)[len(v.heads) :]
        tail = np.fromiter(map(tail_of, new), np.int64, len(new))
        is_head = ids < SYMBOLS
        sym = np.where(is_head, ids, 0).astype(np.int64)
        doc = np.repeat(np.arange(n), sizes)
        local = ids[~is_head].astype(np.int64) - SYMBOLS
        sym[~is_head] = v.tails[tail[local]] if len(local) else 0
        score = model.score(sym, starts, v.heads[END]) / np.log(10)
        score -= np.bincount(doc[~is_head], log_tail[tail[local]] if len(local) else None, n)
        base = np.bincount(doc[is_head], log_head[sym[is_head]], n)
        known = np.bincount(doc[is_head], v.head_counts[sym[is_head]] > 0, n).astype(np.int64)
        own = _pack(self.ids, held, sizes, known, base, score)
        pair, times = np.unique(local * n + doc[~is_head], return_counts=True)
        word, of = pair // n, pair % n
        shard = np.fromiter((zlib.crc32(w) % shards for w in new), np.int64, len(new))
        order = np.argsort(shard[word], kind="stable")
        cuts = np.searchsorted(shard[word][order], np.arange(shards + 1))
        names, slices, blobs = [zlib.crc32(name.encode()) % shards], [name], [_pack("own", own)]
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[s] : cuts[s + 1]]
            some, where = np.unique(word[at], return_inverse=True)
            names.append(s)
            slices.append(name)
            blobs.append(_pack("tail", [new[i] for i in some.tolist()], where.astype(np.uint32), of[at].astype(np.uint32), times[at].astype(np.uint32), held[of[at]]))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(slices), pa.array(blobs, pa.binary())], names=["shard", "slice", "blob"])


def _scored(batches: Iterator[pa.RecordBatch], shared, shards: int) -> Iterator[pa.RecordBatch]:
    model, v = shared.value
    part, turn, held = TaskContext.get().partitionId(), 0, _Slice(v)
    for b in batches:
        for doc, out, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
            held.add(doc, out, text)
            if held.words >= SLICE_WORDS:
                yield held.rows(f"{part}-{turn}", model, v, shards)
                turn, held = turn + 1, _Slice(v)
    if held.words:
        yield held.rows(f"{part}-{turn}", model, v, shards)


def _tail_counts(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's words are counted over all training documents; each slice gets its documents' sums of log10(c + 0.5) and known words."""
    index: dict[bytes, int] = {}
    out, parts = [], []
    for name, raw in zip(group["slice"], group["blob"], strict=True):
        kind, *rest = _unpack(raw)
        if kind == "own":
            out.append((name, rest[0], True))
            continue
        words, where, of, times, held = rest
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))[where]
        parts.append((name, ids, of.astype(np.int64), times.astype(np.int64), held))
    counts = np.zeros(len(index))
    for _, ids, _, times, held in parts:
        counts += np.bincount(ids[~held], times[~held], len(index))
    for name, ids, of, times, _ in parts:
        docs, where = np.unique(of, return_inverse=True)
        c = counts[ids]
        out.append((name, _pack(docs.astype(np.uint32), np.bincount(where, times * np.log10(c + 0.5)), np.bincount(where, times * (c > 0)).astype(np.uint32)), False))
    return pd.DataFrame(out, columns=["slice", "blob", "own"])


def _summed(group: pd.DataFrame, total: int, kinds: int) -> pd.DataFrame:
    own = group.loc[group["own"], "blob"].iloc[0]
    ids, held, sizes, known, base, score = _unpack(own)
    base, known, score = base.copy(), known.copy(), score.copy()
    for raw in group.loc[~group["own"], "blob"]:
        docs, logs, seen = _unpack(raw)
        base[docs] += logs
        score[docs] += logs
        known[docs] += seen
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": sizes, "n_known": known, "train_tokens": total, "base_score": base - sizes * np.log10(total + 0.5 * (kinds + 1)), "score": score})


def score_documents(docs: DataFrame, modulus: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Documents with crc32(doc_id as text) mod modulus = held are never learned from. Null and empty texts are one end
    token; a null id reads as the empty text for the remainder; repeated rows count and are scored each; an empty table
    gives no rows; other columns are dropped. Only frequent words (a fixed number) are broadcast; all others are counted
    in shards and return as sums by document.
    """
    spark = docs.sparkSession
    rows = texts(docs).withColumn("held_out", text_bucket("doc_id", modulus) == held)
    train = rows.filter(~F.col("held_out"))
    v = vocabulary(stored(word_counts(train), "word-counts"))
    model = train_model(train, v)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), v.total // 2_000_000)
    sent = rows.mapInArrow(partial(_scored, shared=spark.sparkContext.broadcast((model, v)), shards=shards), "shard int, slice string, blob binary")
    counted = sent.groupBy("shard").applyInPandas(_tail_counts, "slice string, blob binary, own boolean")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return counted.groupBy("slice").applyInPandas(partial(_summed, total=v.total, kinds=v.kinds), result)
