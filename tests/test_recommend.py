"""Candidates in order, substitutes, features and the fit of plausibility, by hand and against plain versions."""

import math
import random

import numpy as np
import pytest

from seqgraph.functions import chords as C
from seqgraph.operators import color as K
from seqgraph.operators import plausibility as W
from seqgraph.operators import theory as T
from seqgraph.plans import recommend as R
from seqgraph.plans.color import _profile_views
from seqgraph.plans.harmony import _view


def views(spark, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)


def ordered(ngram, graph, theory, similar, cap):
    """The order that candidates have: 16 likeliest, priority figures, then graph and vector finds in turn, then the rest."""
    merged = {}
    for t, p in ngram[:30]:
        merged.setdefault(t, {"p": 0.0, "g": 0.0, "s": None, "by": set()})["p"] = p
        merged[t]["by"].add("ngram")
    for t, p in graph[:100]:
        if p >= 0.005:
            row = merged.setdefault(t, {"p": 0.0, "g": 0.0, "s": None, "by": set()})
            row["g"], row["by"] = max(row["g"], p), row["by"] | {"graph"}
    for t in theory:
        merged.setdefault(t, {"p": 0.0, "g": 0.0, "s": None, "by": set()})["by"].add("theory")
    for t, s in similar[:50]:
        row = merged.setdefault(t, {"p": 0.0, "g": 0.0, "s": None, "by": set()})
        row["s"], row["by"] = s if row["s"] is None else max(row["s"], s), row["by"] | {"embedding"}
    ranked = sorted(merged, key=lambda t: (-merged[t]["p"], t))
    special = {"M:" + f for f in ("ii", "iv", "vi", "bVII", "bVImaj7", "V7")}
    head, rest = ranked[:16], ranked[16:]
    plain = [t for t in rest if t not in special]
    lists = [[t for t in plain if source in merged[t]["by"]] for source in ("graph", "embedding")]
    turns = []
    for k in range(max(map(len, lists))):
        turns += [x[k] for x in lists if k < len(x) and x[k] not in turns]
    out = head + [t for t in rest if t in special] + turns + [t for t in plain if t not in turns]
    return [(t, merged[t]["p"], merged[t]["g"], merged[t]["s"], " ".join(sorted(merged[t]["by"]))) for t in out][:cap]


def test_candidates_in_order(spark):
    rnd = random.Random(5)
    theory = [t for m, t in R._theory() if m == "M"]
    known = sorted({*theory, *(f"M:x{i}" for i in range(40)), "M:V7", "m:i"})
    ngram = sorted(((t, rnd.choice([0.01, 0.02, 0.05]) * rnd.random()) for t in rnd.sample(known, 34) if t != "m:i"), key=lambda x: (-round(x[1], 12), x[0]))
    graph = sorted(((t, rnd.random() / 20) for t in rnd.sample(known, 40) if t != "m:i"), key=lambda x: (-x[1], x[0]))
    sims = [(a, b, rnd.random()) for a, _ in ngram[:7] for b in rnd.sample([k for k in known if k != a], 12)]
    best = {}
    for seed, _ in ngram[:5]:
        for _, b, s in sorted((x for x in sims if x[0] == seed), key=lambda x: (-x[2], x[1]))[:10]:
            best[b] = max(best.get(b, 0.0), s)
    similar = sorted(((t, s) for t, s in best.items() if t != "m:i"), key=lambda x: (-x[1], x[0]))
    own = spark.newSession()
    views(
        own, hreq=([("r", "M:I", None, "M"), ("q", "M:ii", None, "M")], "req string, h1 string, h2 string, m string"), ngt=([("r", t, p, i + 1) for i, (t, p) in enumerate(ngram)], "req string, token string, p double, rk int"),
        rg=([("M:I", t, 5, p) for t, p in graph], "a string, b string, count long, prob double"), theory_dim=(R._theory(), "m string, token string"), token_dim=([(t,) for t in known if t != "M:x3"], "token string"),
        sims=([(a, b, s, sorted((y for y in sims if y[0] == a), key=lambda y: (-y[2], y[1])).index((a, b, s)) + 1) for a, b, s in sims], "t1 string, t2 string, s double, rk int"),
    )
    got = own.sql(T.query(R.candidates(30), R.SELECTS["candidate_sources"])).filter("req = 'r'").orderBy("place").collect()
    drop = lambda rows: [x for x in rows if x[0] != "M:x3"]  # noqa: E731  not realisable
    want = ordered(drop(ngram[:30]), drop([x for i, x in enumerate(graph) if i < 100]), theory, drop(similar[:50]), 30)
    assert [r["token"] for r in got] == [w[0] for w in want]
    for r, w in zip(got, want, strict=True):
        assert (r["ngram_p"], r["graph_p"]) == pytest.approx((w[1], w[2]), abs=1e-9) and r["sources"] == w[4] and (r["similarity"] is None) == (w[3] is None)
    # a request of which nothing is known still has the theory vocabulary
    assert own.sql(T.query(R.candidates(64), R.SELECTS["candidate_sources"])).filter("req = 'q'").count() == len(theory)


def realized_views(own, runs):
    for name in ("theory_dim", "token_dim"):
        _view(own, name, [C.QUALITY_DIM, T.DEGREE_DIM, *R.vocabulary()])
    for name in ("pch", "pkeys"):
        _view(own, name, [C.QUALITY_DIM, K.REFERENCE_DIM, *R.progressions(runs)])


def test_features_by_hand(spark):
    """After C (and G before it) come F and Ab: tones, keys and shares."""
    own = spark.newSession()
    views(
        own, roman=([("major", "M:I")], "mode string, token string"), hreq=([("r", "M:I", "M:V", "M")], "req string, h1 string, h2 string, m string"),
        cand=([("r", "M:IV", 0.5, 0.25, None, 1), ("r", "M:bVI", 1e-9, 0.0, 0.75, 2), ("r", "M:V7/vi", 0.125, 0.0, None, 3)], "req string, token string, ngram_p double, graph_p double, similarity double, place int"),
    )
    realized_views(own, R._PAIRS)
    _profile_views(own)
    got = {r["token"]: r for r in own.sql(T.query([C.KEY_PC_DIM, K.REFERENCE_DIM, *R.features(False)], "SELECT * FROM cl")).collect()}
    rows = {r["token"]: r for r in own.sql(T.query([C.KEY_PC_DIM, K.REFERENCE_DIM, *R.features(False)], "SELECT * FROM cx")).collect()}
    four, six, five = rows["M:IV"], rows["M:bVI"], rows["M:V7/vi"]
    assert four["log_p_ngram"] == pytest.approx(math.log(0.5) / 14) and six["log_p_ngram"] == pytest.approx(math.log(1e-6) / 14)
    assert (four["diatonic"], four["borrowed"], four["applied"], four["chromatic_mediant"]) == (1, 0, 0, 0) and (six["borrowed"], six["chromatic_mediant"], six["diatonic"]) == (1, 1, 0) and five["applied"] == 1
    assert four["common_tones"] == pytest.approx(1 / 3) and six["common_tones"] == pytest.approx(1 / 3)  # C in F A C, and in Ab C Eb
    assert four["tonal_distance"] == pytest.approx(1 / 7) and six["tonal_distance"] == pytest.approx(4 / 7)  # F is one fifth below C, Ab four
    assert four["surprise"] == pytest.approx(1 / 16) and six["surprise"] == 1 and four["delta_surprise"] == four["surprise"]
    assert four["emb_cos"] == 0 and six["emb_cos"] == 0.75 and four["graph_probability"] == 0.25
    # V I resolves (0.95) and I IV doesn't
    assert four["delta_resolution"] == pytest.approx(-0.95)
    logit = {t: sum(w * r[f] for f, w in R.WEIGHTS.items()) for t, r in rows.items()}
    assert {t: r["logit"] for t, r in rows.items()} == pytest.approx(logit)
    total = sum(map(math.exp, logit.values()))
    # ceil(3 * 5%) - 1 = 0: none is dropped
    assert {t: r["p"] for t, r in got.items()} == pytest.approx({t: math.exp(x) / total for t, x in logit.items()})


def test_substitutes_by_hand(spark):
    """For the D minor in C, Dm, G: F and Bb as candidates, with and without the filters."""
    own = spark.newSession()
    schema = "sid string, req string, l string, o string, r string, keep_function boolean, smooth boolean, surprising boolean"
    views(
        own, roman=([("major", "M:I")], "mode string, token string"),
        sreq=([("a", "r", "M:I", "M:ii", "M:V", False, False, False), ("b", "r", "M:I", "M:ii", "M:V", True, False, True), ("c", "r", "M:I", "M:ii", None, False, True, False)], schema),
        cand=([("r", "M:IV"), ("r", "M:bVII"), ("r", "M:ii"), ("r", "m:i")], "req string, token string"), ngt=([("r", "M:IV", 0.5, 1), ("r", "M:ii", 0.3, 2)], "req string, token string, p double, rk int"),
        sright=([("a", "M:IV", 0.25), ("b", "M:IV", 0.25), ("a", "M:bVII", 0.5)], "sid string, token string, p double"),
    )
    realized_views(own, "SELECT token AS a, CAST(NULL AS STRING) AS b FROM (VALUES ('M:IV'), ('M:bVII'), ('M:ii'), ('M:I'), ('M:V'), ('m:i')) t (token)")
    _profile_views(own, ("p_roman", "p_vroot"))
    voice = {r["token"]: (r["b"], r["u0"], r["u1"], r["u2"]) for r in own.sql(T.query(R.substitutes()[:2], "SELECT * FROM svoice")).collect()}
    move = lambda a, b: sum(abs(x - y) for x, y in zip(voice[a], voice[b], strict=True))
    assert all(v[0] % 12 == pc for t, pc in (("M:I", 0), ("M:IV", 5), ("M:V", 7), ("M:bVII", 10)) for v in [voice[t]])
    got = {(r["keep_function"], r["smooth"], r["token"]): r for r in own.sql(T.query(R.substitutes(), R.SELECTS["substitutes"])).collect()}
    four = move("M:I", "M:IV") + move("M:IV", "M:V")
    assert got[False, False, "M:IV"]["motion"] == four
    assert got[False, False, "M:IV"]["score"] == pytest.approx(math.log(0.5) + math.log(0.25) + 0.75 - 0.025 * four)
    assert got[False, False, "M:bVII"]["score"] == pytest.approx(math.log(1e-9) + math.log(0.5) - 0.025 * (move("M:I", "M:bVII") + move("M:bVII", "M:V")))
    assert got[True, False, "M:IV"]["score"] == pytest.approx(math.log(0.5) * 0.85 + math.log(0.25) + 0.75 - 0.025 * four) and (True, False, "M:bVII") not in got  # bVII isn't predominant
    smooth = {t for k, s, t in got if s}
    assert smooth == {t for t in ("M:IV", "M:bVII") if move("M:I", t) <= move("M:I", "M:ii") + 3}


def candidate_rows(seed, queries=120, features=4, weights=(3.0, -2.0, 0.0, 1.0)):
    rng = np.random.default_rng(seed)
    out = []
    for q in range(queries):
        x = rng.normal(size=(rng.integers(2, 7), features))
        p = np.exp(x @ np.array(weights))
        actual = rng.choice(len(x), p=p / p.sum())
        out += [(f"q{q}", f"t{i}", int(rng.integers(1, 4)) if i == 0 else 1, bool(i == actual), q % 2, *map(float, v)) for i, v in enumerate(x)]
    return out


def test_fit_of_plausibility(spark):
    names = [f"f{i}" for i in range(4)]
    schema = "query string, token string, n int, is_actual boolean, odd int, " + ", ".join(f"{n} double" for n in names)
    rows = candidate_rows(1) + [("alone", "t", 1, True, 0, 1.0, 1.0, 1.0, 1.0), ("none", "a", 1, False, 0, 0.0, 0.0, 0.0, 0.0), ("none", "b", 1, False, 0, 0.0, 0.0, 0.0, 0.0)]
    ex = W.examples(spark.createDataFrame(rows, schema).repartition(3), names, "odd").cache()
    assert ex.count() == 120  # queries with one candidate or no actual one don't count
    loss, grad = W.step(ex, [0.5, 0.0, -1.0, 0.0])

    def plain(w):
        total = size = 0.0
        for q in {r[0] for r in rows} - {"alone", "none"}:
            mine = [r for r in rows if r[0] == q]
            logits = [float(np.dot(r[5:], w)) for r in mine]
            n = max(r[2] for r in mine)
            total += n * (math.log(sum(map(math.exp, logits))) - next(x for x, r in zip(logits, mine, strict=True) if r[3]))
            size += n
        return total / size

    w = np.array([0.5, 0.0, -1.0, 0.0])
    assert loss == pytest.approx(plain(w))
    assert grad.tolist() == pytest.approx([-(plain(w + d) - plain(w - d)) / 2e-5 for d in np.eye(4) * 1e-5], abs=1e-5)
    weights, told = W.fit(ex.filter("odd = 0"), ex.filter("odd = 1"), [0.0] * 4, epochs=8)
    assert told["loss"] < 0.7 * told["loss_prior"] and weights[0] > 0.5 and weights[1] < -0.3 and abs(weights[2]) < 0.5
    held = W.examples(spark.createDataFrame(candidate_rows(2), schema), names, "odd")
    assert W.step(held, weights)[0] < 0.7 * W.step(held, [0.0] * 4)[0]
    assert W.step(ex.limit(0), weights) == (0.0, pytest.approx([0.0] * 4))


def test_projection_has_every_pattern(spark, monkeypatch):
    from seqgraph.plans import embeddings as B

    vectors = lambda name, n: spark.range(n).selectExpr(f"concat('{name}', id) AS {name}", "explode(array(0, 1, 2)) AS dim").selectExpr("*", "CAST(dim AS DOUBLE) AS value")
    monkeypatch.setattr(B, "_token_vectors", lambda *_: vectors("token", 700))
    monkeypatch.setattr(B, "_pattern_vectors", lambda *_: vectors("pattern", 6000))
    rows = B.export_projection(spark, None)
    assert rows.columns == ["type", "id", "x", "y"]
    assert {(x["type"], x["count"]) for x in rows.groupBy("type").count().collect()} == {("function", 700), ("pattern", 6000)}
