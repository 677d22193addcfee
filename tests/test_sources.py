"""Readers, marker cutting, streams against batches, and vectors."""

import datetime

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import embed as E
from seqgraph.operators import graph as G
from seqgraph.plans.operations import split_markers
from seqgraph.sources.files import read_corpus_csv, read_corpus_jsonl
from seqgraph.streaming import ops


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,chords,main_genre,genres,release_date,decade\n1,"C G, x", ,rock,,1990.0\n2,A,pop,rock,2001-02-03,\n3,B,,,,unknown\n')
    got = {r["song"]: r for r in read_corpus_csv(spark, f"file://{tmp_path}/c.csv").collect()}
    assert [(got[k]["genre"], got[k]["release"]) for k in "123"] == [("rock", "1990"), ("pop", "2001-02-03"), (None, "unknown")]
    assert got["1"]["chords"] == "C G, x"


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"song_id": "1", "chords": "C G"}\n\n{"id": "2", "progression": "A"}\n{"id": "3", "chords": " ", "chord_progression": "B"}\nbroken\n')
    assert {r["song"]: r["chords"] for r in read_corpus_jsonl(spark, f"file://{tmp_path}/c.jsonl").collect()} == {"1": "C G", "2": "A", "3": "B"}


def test_markers(spark):
    rows = [(1, "lost <Intro_1> C G <verse_2>  <chorus_1>Am F "), (2, "C G"), (3, None)]
    got = [tuple(r) for r in split_markers(spark.createDataFrame(rows, "song long, chords string")).orderBy("song", "ordinal").collect()]
    assert got == [(1, 0, "intro", "C G"), (1, 1, "chorus", "Am F"), (2, 0, None, "C G")]


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=7 * i), i % 3, "abc"[i % 5 % 3], f"{i % 4}") for i in range(60)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, song long, token string, key string").withColumn("event_type", F.col("token"))
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = spark.conf.get("spark.checkpoint.dir")
    pairs = ops.run_available(ops.stream_pairs(stream), out).groupBy("from_token", "to_token").count().collect()
    want = {}
    for s in range(3):
        own = [r[3] for r in rows if r[2] == s]
        for p in zip(own, own[1:], strict=False):
            want[p] = want.get(p, 0) + 1
    assert {(r[0], r[1]): r[2] for r in pairs} == want
    kept = ops.run_available(ops.deduplicated(stream, "key", "30 days"), out)
    assert sorted(r["key"] for r in kept.collect()) == ["0", "1", "2", "3"]
    hours = ops.hourly_counts(batch, 4)
    assert hours.agg(F.sum("n")).first()[0] == 60 and hours.filter("over_limit AND n <= 4").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [2.0, 2.0]), (3, 0, [0.0, 3.0]), (4, 1, [1.0, 0.0]), (5, 0, [0.0, 0.0])], "id long, model int, vec array<float>")
    got = {(r["query"], r["rank"]): (r["id"], r["cosine"]) for r in G.cosine_topk(v.filter("id = 1"), v, 2).collect()}
    assert got[1, 1][0] == 2 and got[1, 1][1] == pytest.approx(0.5**0.5) and len(got) == 2
    e = spark.createDataFrame([("a", "b", 3), ("b", "c", 1), ("c", "c", 9)], "src string, dst string, count long")
    norms = E.fastrp(e, 4).groupBy("token").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert {r["token"] for r in norms} == {"a", "b", "c"} and all(r["n"] == pytest.approx(1) for r in norms)


def test_diverse_choice(spark):
    rows = [("q", "a", 1.0, 7), ("q", "b", 0.95, 7), ("q", "c", 0.5, 56), ("r", "x", 1.0, 0)]
    got = {(r["query"], r["rank"]): r["token"] for r in E.greedy_diverse(spark.createDataFrame(rows, "query string, token string, score double, mask int"), 3).collect()}
    assert got == {("q", 1): "a", ("q", 2): "c", ("q", 3): "b", ("r", 1): "x"}


def test_hourly_counts_over_batches_with_late_rows(spark):
    """Four batches; an old row in the second is still within the watermark, one in the last is not and is dropped."""
    t0 = datetime.datetime(2024, 1, 1, 10)
    at = lambda h, m: t0 + datetime.timedelta(hours=h, minutes=m)
    rows = [("a", at(0, m), 0) for m in range(3)] + [("b", at(1, 30), 0), ("a", at(2, 0), 1), ("a", at(0, 50), 1), ("a", at(9, 0), 1), ("b", at(9, 5), 2), ("b", at(9, 6), 3), ("b", at(1, 31), 3), ("a", at(9, 59), 3)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp, slot int")
    out = spark.conf.get("spark.checkpoint.dir")
    told = ops.run_updates(ops.hourly_counts(ops.in_batches(df, "slot", 4, out), 3, "2 hours"), out).orderBy("batch", "event_type", "hour").collect()
    got = [(r["event_type"], (r["hour"] - t0).seconds // 3600, r["n"], r["over_limit"]) for r in told]
    # the first hour of a is told twice, and over its limit only once the second batch is there
    assert got == [("a", 0, 3, False), ("b", 1, 1, False), ("a", 0, 4, True), ("a", 2, 1, False), ("a", 9, 1, False), ("b", 9, 1, False), ("a", 9, 2, False), ("b", 9, 2, False)]
    assert told[0]["batch"] < told[2]["batch"] < told[6]["batch"]


def test_stream_keeps_what_a_batch_keeps(spark):
    day = datetime.timedelta(days=1)
    t0 = datetime.datetime(2024, 1, 1)
    days = {"a": [0, 1, 6, 7, 8, 13, 14, 15, 40], "b": [3, 4, 5, 11, 30], "c": [20]}
    rows = [(k, t0 + d * day, min(3, d // 7)) for k, ds in days.items() for d in ds] + [("a", t0 + 2 * day, 3)]  # the last is late: 41 days behind, and a duplicate
    df = spark.createDataFrame(rows, "key string, ts timestamp, slot int")
    out = spark.conf.get("spark.checkpoint.dir")
    kept = ops.run_available(ops.stream_kept_within(ops.in_batches(df, "slot", 4, out), "key", 7 * 86400), out)
    got = sorted((r["key"], (r["ts"] - t0).days) for r in kept.collect())
    assert got == sorted((r["key"], (r["ts"] - t0).days) for r in ops.kept_within(df, "key", 7 * 86400).collect())
    assert got == [("a", 0), ("a", 7), ("a", 14), ("a", 40), ("b", 3), ("b", 11), ("b", 30), ("c", 20)]
