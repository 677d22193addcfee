"""Sequence operators on hand-worked tokens, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from seqgraph.operators import graph as G
from seqgraph.operators import predict as P
from seqgraph.operators import sequence as S
from seqgraph.sources.fixtures import materialize

SCHEMA = "song long, ordinal long, section string, genre string, decade string, pos long, token string"


def positions(spark, *songs):
    rows = [(s, o, sec, g, d, i, t) for s, (o, sec, g, d, tokens) in enumerate(songs) for i, t in enumerate(tokens.split())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def one(spark):
    return positions(spark, (0, None, None, None, "A B C A B D"))


def test_ngrams_by_hand(one):
    contexts = S.kept_contexts(one, 1)
    rows = S.ngram_counts(one, contexts, {3: 100, 4: 100, 5: 100}).collect()
    table = {(r["order"], r["history"]): {x["token"]: (x["cnt"], x["cont"]) for x in rows if (x["order"], x["history"]) == (r["order"], r["history"])} for r in rows}
    assert {t: c for t, (c, _) in table[1, ""].items()} == {"A": 2, "B": 2, "C": 1, "D": 1}
    assert table[2, "A"] == {"B": (2, 1)} and table[2, "B"] == {"C": (1, 1), "D": (1, 1)}
    assert {r["order"] for r in rows} == {1, 2}


def test_null_and_empty_dimensions_give_no_context(spark):
    p = positions(spark, (0, "", None, "d", "A B"))
    assert {r["context"] for r in S.explode_contexts(p).collect()} == {"global", "decade:d"}


def test_transitions_by_hand(spark):
    p = positions(spark, (0, "v", "g", None, "A B A B"), (0, "v", None, None, "A C"))
    rows = {(r["context"], r["from_token"], r["to_token"]): r for r in S.transitions(p, 0).collect()}
    r = rows["global", "A", "B"]
    assert (r["count"], r["support"]) == (2, 1) and r["prob"] == pytest.approx(2 / 3) and r["pmi"] == pytest.approx(math.log(2 * 4 / (3 * 2)))
    assert rows["genre_section:g:v", "A", "B"]["prob"] == 1.0
    assert {c for c, _, _ in rows} == {"global", "genre:g", "section:v", "genre_section:g:v"}
    sums = S.transitions(p, 0).groupBy("context", "from_token").agg(F.sum("prob").alias("p")).collect()
    assert all(x["p"] == pytest.approx(1) for x in sums)


def test_patterns_merge_rotations(spark):
    rows = [(1, 0, "v", None, None, ["B", "C", "A", "B"]), (2, 0, "v", None, None, ["A", "B", "C"])]
    s = spark.createDataFrame(rows, "song long, ordinal long, section string, genre string, decade string, tokens array<string>")
    found, lifts = S.patterns(s, 3, 0)
    assert [tuple(r) for r in found.collect()] == [("A B C", 3, 3, 2, "0,1,2")]
    assert all(r["lift"] > 0 for r in lifts.collect())


def test_distributions_sum_to_one(spark):
    p = positions(spark, *[(0, "v", "g" if i % 2 else None, None, "A B C A B D A C B A A B C D" if i % 3 else "B A C D D A B C") for i in range(9)])
    contexts = S.kept_contexts(p, 1)
    grams = S.ngram_counts(p, contexts, {})
    stats = S.discount_stats(grams)
    held = P.held_positions(p)
    assert P.sample_positions(held, 40).count() == 40
    requests = held.select("req", "hist", "genre", "section").distinct()
    rows = P.evidence(P.context_chain(requests, contexts), grams, stats).cache()
    assert requests.count() < held.count()
    for how in ({}, {"cap": 2}, {"lift": False}):
        d = P.distribution(rows, **how).groupBy("req").agg(F.sum("p").alias("p"), F.min("p").alias("low")).collect()
        assert len(d) == requests.count() and all(r["p"] == pytest.approx(1) and r["low"] >= 0 for r in d)
    many = P.distributions(rows, [P.Variant("a"), P.Variant("b", cap=3, contexts=False), P.Variant("c", k=10.0, lift=False)])
    one = P.distribution(rows).select("req", "token", F.round("p", 9).alias("p"))
    assert not many.filter("model = 'a'").select("req", "token", F.round("p", 9).alias("p")).exceptAll(one).count()
    m = P.position_metrics(many, held, ["a", "b", "c"])
    assert m.count() == 3 * held.count() and m.filter("covered = 1 AND rank IS NULL").isEmpty()


def test_split_agrees_with_whole_digest(spark):
    import hashlib

    got = spark.range(300).select("id", P.assign_split(F.col("id")).alias("s")).collect()
    name = {0: "test", 1: "dev"}
    assert all(r["s"] == name.get(int(hashlib.sha256(str(r["id"]).encode()).hexdigest(), 16) % 20, "train") for r in got)


def test_paths_against_all_walks(spark):
    import itertools
    import random

    rnd = random.Random(3)
    names = "abcdefg"
    edges = {(x, y): rnd.uniform(0.05, 1) for x in names for y in names if rnd.random() < 0.5}
    e = spark.createDataFrame([("TRANSITIONS_TO", x, y, p) for (x, y), p in edges.items()], "type string, src string, dst string, prob double")
    pairs = spark.createDataFrame([("a", "g"), ("b", "c")], "src string, dst string")
    got = {(r["src"], r["dst"], r["rank"]): (r["path"], round(r["cost"], 6)) for r in G.k_best_paths(e, pairs, 3, 4).collect()}
    for s, d in (("a", "g"), ("b", "c")):
        walks = []
        for n in range(4):
            for mid in itertools.permutations([x for x in names if x not in (s, d)], n):
                path = (s, *mid, d)
                if all(x in edges for x in zip(path, path[1:], strict=False)):
                    walks.append((round(sum(-math.log(edges[x]) for x in zip(path, path[1:], strict=False)), 6), " ".join(path)))
        for i, (cost, path) in enumerate(sorted(walks)[:3]):
            assert got[s, d, i + 1] == (path, cost)


def test_paths_that_never_step_down(spark):
    e = spark.createDataFrame([("TRANSITIONS_TO", "a", "b", 0.9), ("TRANSITIONS_TO", "b", "d", 0.9), ("TRANSITIONS_TO", "a", "c", 0.2), ("TRANSITIONS_TO", "c", "d", 0.2), ("OTHER", "a", "d", 0.5)], "type string, src string, dst string, prob double")
    pairs, level = spark.createDataFrame([("a", "d")], "src string, dst string"), spark.createDataFrame([("a", 1), ("b", 0), ("c", 2), ("d", 3)], "id string, level int")
    assert [r["path"] for r in G.k_best_paths(e, pairs, 3, 4).orderBy("rank").collect()] == ["a b d", "a d", "a c d"]
    assert [r["path"] for r in G.k_best_paths(e, pairs, 3, 4, level, rising=True).orderBy("rank").collect()] == ["a d", "a c d"]


@pytest.mark.parametrize("rising, most", [(False, 2), (True, None), (True, 2)])
def test_six_edges_with_levels_against_all_walks(spark, rising, most):
    import itertools
    import random

    rnd = random.Random(11)
    names = "abcdefgh"
    edges = {(x, y): rnd.uniform(0.05, 1) for x in names for y in names if x != y and rnd.random() < 0.6}
    level = {x: rnd.randint(0, 3) for x in names if x not in "ad"} | {"a": 3}  # d has none: 0
    allowed = {(x, y) for x, y in edges if (not rising or level.get(x, 0) <= level.get(y, 0)) and (most is None or level.get(y, 0) <= most)}
    e = spark.createDataFrame([("TRANSITIONS_TO", x, y, p) for (x, y), p in edges.items()], "type string, src string, dst string, prob double")
    pairs = [("a", "h"), ("b", "c"), ("a", "d"), ("d", "h"), ("c", "g")]
    levels = spark.createDataFrame(list(level.items()), "id string, level int")
    found = G.k_best_paths(e, spark.createDataFrame(pairs, "src string, dst string"), 5, 6, levels, rising, most, keep=materialize).collect()
    got = {(r["src"], r["dst"], r["rank"]): (r["path"], round(r["cost"], 6)) for r in found}
    want = {}
    for s, d in pairs:
        walks = []
        for n in range(6):
            for mid in itertools.permutations([x for x in names if x not in (s, d)], n):
                path = (s, *mid, d)
                if all(x in allowed for x in zip(path, path[1:], strict=False)):
                    walks.append((round(sum(-math.log(edges[x]) for x in zip(path, path[1:], strict=False)), 6), " ".join(path)))
        want |= {(s, d, i + 1): (path, cost) for i, (cost, path) in enumerate(sorted(walks)[:5])}
    assert got == want and got


def test_constraints_need_levels(spark):
    with pytest.raises(ValueError, match="levels"):
        G.k_best_paths(spark.range(1), spark.range(1), rising=True)


def test_graph_filter_and_merge(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("T", "a", "b", 0.5), ("T", "a", "c", 0.9), ("T", "b", "a", None)], "type string, src string, dst string, prob double")
    assert G.graph_filter(nodes, e, ("T",), 0.0).count() == 2 and G.graph_filter(nodes, e, ("T",), 0.1).count() == 1
    assert G.merged(nodes.withColumn("v", F.lit(1)), nodes.withColumn("v", F.lit(2)), ["id"]).select("v").distinct().collect()[0][0] == 2
