"""Reversible line dedup: exact reference counts by line, and sharded cuckoo filters in front of them.

The reference-count table holds, for each long enough line key, how many documents have it and the largest
of them. A cuckoo filter for each shard holds the keys that are common; lines are dealt to the shards, where their
filter meets them, and a line whose key isn't in it is certainly kept, so only few lines go on to the exact table.
Documents can be added to and taken from the postings; counts and filters follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stored, texts

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4
#: Shards at least, and keys in the filter of a shard, about: their number grows with the keys.
SHARDS, SHARD_KEYS = 64, 250_000


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    """Cuckoo filter of 64-bit keys: two buckets of four 16-bit prints each; keys can be added, deleted and looked up in bulk.

    A deletion must be of a key that was added. A filter that can't place a print doubles and starts anew,
    for which it asks for all its keys again (add_all).
    """

    def __init__(self, capacity: int):
        n = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (SLOTS * 0.8)))))
        self.table = np.zeros((n, SLOTS), np.uint16)

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = _mix(keys.astype(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = h & self.mask
        return prints, first, first ^ (_mix(prints.astype(np.uint64)) & self.mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._places(keys)
        return (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)

    def _put(self, f: int, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        at = b
        for turn in range(500):  # move prints on to their other bucket
            slot = turn % SLOTS
            f, self.table[at, slot] = int(self.table[at, slot]), f
            at = int(at ^ int(_mix(np.array([f], np.uint64))[0] & self.mask))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = f
                return True
        return False

    def add(self, keys: np.ndarray) -> bool:
        """False if a print found no place; the filter is then to be built anew with more room."""
        return all(self._put(int(f), int(a), int(b)) for f, a, b in zip(*self._places(keys), strict=True))

    def delete(self, keys: np.ndarray) -> None:
        for f, a, b in zip(*self._places(keys), strict=True):
            for at in (int(a), int(b)):
                held = np.flatnonzero(self.table[at] == f)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = max(len(keys), 4)
        while not (made := cls(room)).add(keys):
            room *= 2
        return made

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        return made


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """A row for each document and distinct line key of min_chars code points or more: key (two 64-bit hashes), doc_id.

    Every row of docs counts as a document, also where its id is null or repeated.
    """
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars))
    out = texts(docs).select("doc_id", F.explode(keys).alias("line"))
    return out.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2"), "doc_id")


def reference_counts(found: DataFrame) -> DataFrame:
    """The exact table: key, n_docs and top_doc (the largest id that holds it; null only if no id is known)."""
    return found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))


def _filters(keys: pd.DataFrame) -> pd.DataFrame:
    k = keys["k1"].to_numpy(np.int64).view(np.uint64)
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "n_keys": [len(k)], "cuckoo": [CuckooFilter.of(k).to_bytes()]})


def cuckoo_filters(common: DataFrame, shards: int) -> DataFrame:
    """shard, n_keys and filter bytes over the common keys; a shard holds the keys whose first hash falls to it."""
    return common.select("k1", F.pmod("k1", F.lit(shards)).cast("int").alias("shard")).groupBy("shard").applyInPandas(_filters, "shard int, n_keys long, cuckoo binary")


def shard_loads(common: DataFrame, shards: int) -> DataFrame:
    """shard, salts: in how many parts the lines of each shard with common keys are dealt, so that no part has much more than the mean shard."""
    loads = common.groupBy(F.pmod("k1", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n_docs").alias("load"))
    mean = loads.agg(F.coalesce(F.sum("load"), F.lit(0)) / shards).first()[0]
    return loads.select("shard", F.ceil(F.col("load") / max(mean or 1.0, 1.0)).cast("int").alias("salts"))


def _passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard and salt, a filter before the lines it is for; gives the lines that it may hold. One filter is in memory at a time."""
    cuckoo = None
    for b in batches:
        raw, k = b.column("cuckoo"), b.column("k1").to_numpy(zero_copy_only=False)
        marks = np.flatnonzero(np.asarray(raw.is_valid())).tolist()
        hit = np.zeros(len(k), bool)
        for lo, hi in zip([-1, *marks], [*marks, len(k)], strict=True):
            if lo >= 0:
                cuckoo = CuckooFilter.from_bytes(raw[lo].as_py())
            if lo + 1 < hi:
                hit[lo + 1 : hi] = cuckoo.contains(k[lo + 1 : hi].astype(np.int64).view(np.uint64))
        yield b.select([n for n in b.schema.names if n not in ("shard", "salt", "cuckoo")]).filter(pa.array(hit))


def maybe_common(lines: DataFrame, filters: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The lines (with a column k1) that the filter of their shard may hold. Shards with many lines are dealt in parts, their filter to each."""
    out = lines.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).join(loads, "shard")  # a shard without common keys keeps its lines
    out = out.withColumn("salt", F.pmod(F.xxhash64(*lines.columns), F.col("salts")).cast("int")).select("shard", "salt", *lines.columns, F.lit(None).cast("binary").alias("cuckoo"))
    each = filters.join(loads, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in lines.schema if f.name != "k1"], F.lit(0).cast("long").alias("k1"), "cuckoo")
    met = out.unionByName(each).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("cuckoo").isNull())
    return met.mapInArrow(_passing, lines.schema)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int = SHARDS, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of each document.

    A key of min_chars code points held by min_docs documents or more stays only in the document with the
    largest id; with equal largest ids it stays in each; a null id is below all others. counts: the table of a
    LineIndex, else it is made from docs. Null and empty texts have one empty line; repeated rows count as
    documents of their own; an empty table gives no rows; other columns are dropped.
    """
    counts = reference_counts(postings(docs, min_chars)) if counts is None else counts
    common = stored(counts.filter(F.col("n_docs") >= min_docs), "common-lines")
    shards = max(shards, -(-common.count() // SHARD_KEYS))
    filters, loads = stored(cuckoo_filters(common, shards), "line-filters"), stored(shard_loads(common, shards), "line-loads")
    body = texts(docs).withColumn("body", F.xxhash64("text"))
    lines = body.select("doc_id", "body", F.posexplode(F.transform(F.split("text", "\n", -1), line_key)).alias("at", "line")).filter(F.char_length("line") >= min_chars)
    lines = lines.select(F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("line"), "line").alias("k2"), "doc_id", "body", "at")
    doomed = maybe_common(lines, filters, loads, shards).join(common, ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    doomed = doomed.groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).agg(F.collect_set("at").alias("drops"))
    out = body.join(doomed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    split = F.split("text", "\n", -1)
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.array_contains("drops", i)), "\n"))
    return out.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


class LineIndex:
    """Postings of all documents seen so far, as a folder of batches; documents can be added and taken out again.

    counts() is exact for what is in; filters() are the shards' cuckoo filters for it. update_filters() moves a
    filter table on by the keys that became or ceased to be common, without looking at the other keys.
    """

    def __init__(self, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int = SHARDS):
        self.spark, self.min_docs, self.min_chars, self.shards = docs.sparkSession, min_docs, min_chars, shards
        self.path = shared_path(self.spark, "line-postings")
        self._append(docs, 1)

    def _append(self, docs: DataFrame, sign: int) -> None:
        postings(docs, self.min_chars).withColumn("sign", F.lit(sign)).write.mode("append").parquet(self.path)

    def insert(self, docs: DataFrame) -> None:
        self._append(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """docs as they were inserted."""
        self._append(docs, -1)

    def counts(self) -> DataFrame:
        live = self.spark.read.parquet(self.path).groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("n")).filter("n > 0")
        return live.groupBy("k1", "k2").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("top_doc"))

    def filters(self) -> DataFrame:
        return cuckoo_filters(self.counts().filter(F.col("n_docs") >= self.min_docs), self.shards)

    def dedup(self, docs: DataFrame) -> DataFrame:
        return dedup_lines(docs, self.min_docs, self.min_chars, self.shards, self.counts())


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, shards: int, min_docs: int = 3) -> DataFrame:
    """The filter table for the counts `after`, from the one for `before`: adds and deletes only the keys that changed. A filter that
    has no place for a key is built anew from all its keys."""
    keys = lambda t: t.filter(F.col("n_docs") >= min_docs).select("k1", "k2")
    changed = keys(after).exceptAll(keys(before)).withColumn("add", F.lit(True)).unionByName(keys(before).exceptAll(keys(after)).withColumn("add", F.lit(False)))
    changed = changed.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))

    def moved(key, held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        k, add = change["k1"].to_numpy(np.int64).view(np.uint64), change["add"].to_numpy(bool)
        n = int(held["n_keys"].iloc[0]) if len(held) else 0
        cuckoo = CuckooFilter.from_bytes(held["cuckoo"].iloc[0]) if n else CuckooFilter(max(4, 2 * len(k)))
        cuckoo.delete(k[~add])
        fits = cuckoo.add(k[add])
        return pd.DataFrame({"shard": [key[0]], "n_keys": [n + int(add.sum()) - int((~add).sum())], "cuckoo": [cuckoo.to_bytes() if fits else None]})

    out = stored(filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(moved, "shard int, n_keys long, cuckoo binary"), "line-filters")
    full = out.filter(F.col("cuckoo").isNull()).select("shard")
    again = keys(after).withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).join(full, "shard", "left_semi")
    return out.filter(F.col("cuckoo").isNotNull()).unionByName(cuckoo_filters(again, shards))
