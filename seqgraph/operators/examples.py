"""Examples of patterns and transitions: where they occur, a bounded choice of places for each, and look-ups by context. Frequent items by a mergeable sketch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sequence as S


def pattern_places(sections: DataFrame, patterns: DataFrame, lengths: tuple[int, int] = (3, 8), keep=lambda df, name: df) -> DataFrame:
    """pattern, song, ordinal, section, pos, offset: each window of a section that is a rotation of a pattern, and by how many tokens it is turned.

    Only distinct windows are turned; the places of all others than the patterns' never leave their task but for a join by the window.
    """
    once = S.windows(sections, lengths).select("w").distinct()
    turned = once.select("w", S.smallest_rotation(F.col("w")).alias("best")).select("w", "best.pattern", "best.offset")
    # windows and places are estimated at the size of what they are cut from: without the hints they might be broadcast through the driver
    known = keep(turned.hint("merge").join(patterns.select("pattern"), "pattern"), "pattern-windows")
    cut = lambda n: F.when(F.size("tokens") >= n, F.transform(F.sequence(F.lit(1), F.size("tokens") - n + 1), lambda i: F.struct((i - 1).cast("long").alias("pos"), F.array_join(F.slice("tokens", i, n), " ").alias("w"))))
    every = F.flatten(F.array_compact(F.array(*[cut(n) for n in range(lengths[0], lengths[1] + 1)])))
    places = sections.select("song", "ordinal", "section", F.explode(every).alias("x")).select("song", "ordinal", "section", "x.*")
    return places.hint("merge").join(known, "w").select("pattern", "song", "ordinal", "section", "pos", "offset")


def chosen(places: DataFrame, *key: str, external: str = "external", seed: int = 5, first: int = 20, keep: int = 5) -> DataFrame:
    """places with rank: of the first of a key in corpus order (song, ordinal, pos), those with an external id first, then by seeded hash.

    Both choices bound what a key sends to the task that ranks it, however many places it has.
    """
    of = Window.partitionBy(*key)
    early = places.withColumn("_nth", F.row_number().over(of.orderBy("song", "ordinal", "pos"))).filter(F.col("_nth") <= first)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *key, "song", "ordinal", "pos"))
    return early.withColumn("rank", F.row_number().over(of.orderBy(F.col(external).isNull(), order))).filter(F.col("rank") <= keep).drop("_nth")


def by_context(requests: DataFrame, examples: DataFrame, *key: str, limit: str = "limit") -> DataFrame:
    """req and the examples (columns of examples, with nth) that have the request's key and each of genre, section and decade that it gives; by rank, at most its limit.

    What a request gives decides which join it takes part in: one join on equal keys for each set of given columns.
    """
    dims = ("genre", "section", "decade")
    found = []
    for mask in range(1 << len(dims)):
        given = [d for i, d in enumerate(dims) if mask >> i & 1]
        asked = reduce(lambda df, d: df.filter(F.col(d).isNotNull() if d in given else F.col(d).isNull()), dims, requests)
        found.append(asked.select("req", *key, *given, F.col(limit).alias("_limit")).join(examples, [*key, *given]).select("req", "_limit", *examples.columns))
    rows = reduce(DataFrame.unionByName, found)
    nth = F.row_number().over(Window.partitionBy("req").orderBy("rank", "song", "ordinal", "pos"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= F.col("_limit")).drop("_limit")


def _summaries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """item, n: at most so many counters; what falls out is taken off all of them, and summed as the error."""
    kept: Counter = Counter()
    error = 0
    for b in batches:
        for item, n in zip(*[c.to_pylist() for c in b.columns], strict=True):
            kept[item] += n
        if len(kept) > counters:
            off = sorted(kept.values(), reverse=True)[counters]
            error += off
            kept = Counter({k: v - off for k, v in kept.items() if v > off})
    yield pa.RecordBatch.from_arrays([pa.array([*kept, None], pa.string()), pa.array([*kept.values(), error], pa.int64())], names=["item", "n"])


def heavy_hitters(items: DataFrame, support: int, counters: int | None = None) -> DataFrame:
    """item, low, high: items that may occur support times or more, with bounds of their count.

    items: item, n (a count of one or more; null items don't count). Each task keeps at most counters items; its summary's error is at most its total over counters, and the errors of
    all tasks add up to the difference of the bounds. While that is below support, no item that occurs so often is missing; without counters, as many are kept as make sure of it.
    """
    rows = items.filter("item IS NOT NULL").select(F.col("item").cast("string").alias("item"), F.col("n").cast("long").alias("n"))
    if counters is None:
        counters = (rows.agg(F.sum("n")).first()[0] or 0) // support + 1
    parts = rows.mapInArrow(partial(_summaries, counters=counters), "item string, n long")
    low = parts.groupBy("item").agg(F.sum("n").alias("low"))
    error = low.filter("item IS NULL").select(F.col("low").alias("error"))  # one row
    return low.filter("item IS NOT NULL").join(F.broadcast(error)).select("item", "low", (F.col("low") + F.col("error")).alias("high")).filter(F.col("high") >= support)
