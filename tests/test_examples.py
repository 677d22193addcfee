"""Places of patterns, the choice among them, look-ups by what a request gives, and bounds of frequent items."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import examples as X

SECTIONS = "song long, ordinal long, section string, genre string, decade string, tokens array<string>"


def test_places_of_patterns(spark):
    rows = [(1, 0, "v", "g", "d", "A B C A B C".split()), (1, 1, "c", None, None, "B C A".split()), (2, 0, None, "g", "d", "C B A".split()), (3, 0, "v", "g", "d", [])]
    found = X.pattern_places(spark.createDataFrame(rows, SECTIONS), spark.createDataFrame([("A B C",), ("A C B",), ("A B C A",)], "pattern string"))
    got = sorted((r["pattern"], r["song"], r["ordinal"], r["pos"], r["offset"]) for r in found.collect())
    # offset: how far the window is turned to be the pattern
    assert got == [("A B C", 1, 0, 0, 0), ("A B C", 1, 0, 1, 2), ("A B C", 1, 0, 2, 1), ("A B C", 1, 0, 3, 0), ("A B C", 1, 1, 0, 2), ("A C B", 2, 0, 0, 2)]


def test_choice_of_examples(spark):
    rows = [("k", s, o, p, f"x{s}" if s % 3 else None) for s in range(9) for o in range(2) for p in range(2)] + [("one", 5, 0, 0, None)]
    random.Random(1).shuffle(rows)
    got = [(r["key"], r["rank"], r["song"], r["ordinal"], r["pos"]) for r in X.chosen(spark.createDataFrame(rows, "key string, song long, ordinal long, pos long, external string").repartition(3), "key").orderBy("key", "rank").collect()]
    early = sorted(r[1:4] for r in rows if r[0] == "k")[:20]
    want = sorted(early, key=lambda r: (r[0] % 3 == 0, hashlib.md5(f"5:k:{r[0]}:{r[1]}:{r[2]}".encode()).hexdigest()))[:5]
    assert got == [("k", i, *w) for i, w in enumerate(want, 1)] + [("one", 1, 5, 0, 0)]


def test_examples_by_what_is_asked(spark):
    ex = [("a", s, 0, 0, s + 1, g, sec, d) for s, (g, sec, d) in enumerate([("rock", "v", "90"), ("rock", "c", "90"), ("pop", "v", "80"), (None, "v", "90"), ("rock", "v", "80")])] + [("b", 9, 0, 0, 1, "rock", "v", "90")]
    examples = spark.createDataFrame(ex, "key string, song long, ordinal long, pos long, rank int, genre string, section string, decade string")
    asks = [("all", "a", None, None, None, 2), ("g", "a", "rock", None, None, 9), ("gs", "a", "rock", "v", None, 9), ("d", "a", None, None, "90", 9), ("gsd", "a", "rock", "v", "80", 9), ("no", "a", "jazz", None, None, 9), ("b", "b", None, "v", None, 1)]
    found = X.by_context(spark.createDataFrame(asks, "req string, key string, genre string, section string, decade string, limit int"), examples, "key")
    got = {}
    for r in found.orderBy("req", "nth").collect():
        got.setdefault(r["req"], []).append(r["song"])
    assert got == {"all": [0, 1], "g": [0, 1, 4], "gs": [0, 4], "d": [0, 1, 3], "gsd": [4], "b": [9]}


@pytest.mark.parametrize("counters", [5, 60, 1000, None])
def test_bounds_of_frequent_items(spark, counters):
    rnd = random.Random(3)
    items = [(f"w{int(rnd.paretovariate(0.9))}", rnd.randint(1, 3)) for _ in range(4000)] + [(None, 50)]
    exact = Counter()
    for w, n in items:
        exact[w] += n
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r["item"]: (r["low"], r["high"]) for r in X.heavy_hitters(spark.createDataFrame(items, "item string, n int").repartition(4), 150, counters).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    total = sum(n for w, n in exact.items() if w)
    counters = counters or total // 150 + 1
    assert total / counters > 150 or {w for w, n in exact.items() if n >= 150 and w} <= set(found)
    assert all(low <= exact[w] <= high for w, (low, high) in found.items())
    assert all(high - low <= total / counters for low, high in found.values())
    assert counters < 1000 or all(low == high for low, high in found.values())
    assert X.heavy_hitters(spark.createDataFrame(items[:0], "item string, n int"), 1).count() == 0


def test_places_are_never_broadcast(spark):
    rows = [(1, 0, "verse", "g", "d", ["A", "B", "C", "A"]), (2, 0, "verse", "g", "d", ["C", "A", "B"])]
    found = X.pattern_places(spark.createDataFrame(rows, SECTIONS), spark.createDataFrame([("A B C",)], "pattern string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and found.count() == 3
