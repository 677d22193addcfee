"""Voice leading, realised tokens, color, prediction's neighbours: hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from seqgraph.functions import chords as C
from seqgraph.operators import color as K
from seqgraph.operators import theory as T
from seqgraph.plans.color import _ABST, SELECTS
from seqgraph.streaming import ops

LINES = "song long, ordinal long, section string, genre string, decade string, external_id string, pos long, symbol string"


def lines(spark, *bodies):
    return spark.createDataFrame([(i, 0, "v", None, None, None, k, x) for i, b in enumerate(bodies) for k, x in enumerate(b.split())], LINES)


def test_leading_of_relative_and_parallel_chords(spark):
    known = [*T.chord_dim(T.SPARK), C.TONE_DIM, *K.voicings(), *_ABST, *K.leading_targets(1), *K.motions()]
    got = {(r["from_chord"], r["to_chord"]): r for r in T.run(lines(spark, "C Am C Am C Am C F C", "Cm C Cm C Cm C"), known, K.LEADING).collect()}
    r = got["C:maj", "A:min"]
    # the fifth rises to the root of A minor and the bass falls by a minor third; F follows too rarely
    assert (r["total_motion"], r["max_voice_motion"], r["common_tones"], r["bass_motion"], r["parsimonious"]) == (5, 3, 2, 3, "R")
    assert got["C:min", "C:maj"]["parsimonious"] == "P" and got["C:min", "C:maj"]["total_motion"] == 1
    assert len(got) == 3  # one target for each source


def test_realised_tokens(spark):
    tokens = [("major", "M:V7/V"), ("major", "M:ii"), ("minor", "m:VII"), ("major", "M:viio7/vi"), ("major", "M:subV7/V"), ("major", "M:?"), ("major", "M:bVImaj7")]
    spark.createDataFrame(tokens, "mode string, token string").createOrReplaceTempView("some_tokens")
    got = {r["token"]: (r["root_pc"], r["quality"]) for r in spark.sql(T.query([C.QUALITY_DIM, T.DEGREE_DIM, *K.realized("some_tokens")], SELECTS["token_dim"])).collect()}
    lof = {r["token"]: r["lof"] for r in spark.sql(T.query([C.QUALITY_DIM, T.DEGREE_DIM, *K.realized("some_tokens")], "SELECT token, lof FROM token_dim")).collect()}
    # D, D, G, G# (the leading tone of A), Ab (above G), Ab
    assert lof == {"M:V7/V": 2, "M:ii": 2, "m:VII": 1, "M:viio7/vi": 8, "M:subV7/V": -4, "M:bVImaj7": -4}
    assert got == {"M:V7/V": (2, "7"), "M:ii": (2, "min"), "m:VII": (7, "maj"), "M:viio7/vi": (8, "dim7"), "M:subV7/V": (8, "7"), "M:bVImaj7": (8, "maj7")}


def test_spelling_in_keys():
    at = lambda key, mode: {pc: (note, home) for pc, note, _, home in C.key_spelling(key, mode)}
    assert at("Eb", "major")[8] == ("Ab", True) and at("Eb", "major")[6] == ("Gb", False)
    assert at("E", "major")[8] == ("G#", True) and at("E", "major")[10] == ("A#", False) and at("A", "minor")[0] == ("C", True)
    assert C.quality_class((0, 4, 7, 10, 2)) == ("dom7", ["9"]) and C.quality_class((0, 5, 7, 10)) == ("sus", []) and C.quality_class((0, 3, 7, 9)) == ("min", ["13"])


def test_rows_kept_within_a_window(spark):
    day = lambda d, k="a": (k, f"2024-01-{d:02d} 00:00:00")
    e = spark.createDataFrame([day(1), day(2), day(7), day(8), day(9), day(20), day(3, "b")], "key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r["key"], r["d"]) for r in ops.kept_within(e, "key", 7 * 86400).select("key", F.dayofmonth("ts").alias("d")).collect())
    assert got == [("a", 1), ("a", 8), ("a", 20), ("b", 3)]


@pytest.mark.parametrize("value, want", [("0.0e0", 0.0), ("5.0e0", 0.5), ("20.0e0", 1.0)])
def test_normalised_by_percentiles(spark, value, want):
    got = spark.sql(f"SELECT {K.normalized(value)} AS x FROM (SELECT 0.0e0 AS p05, 10.0e0 AS p95) n").first()["x"]
    assert got == pytest.approx(want)
    assert spark.sql(f"SELECT {K.normalized(value)} AS x FROM (SELECT 3.0e0 AS p05, 3.0e0 AS p95) n").first()["x"] == 0.5


def test_axes_with_a_model(spark):
    """Surprise in bits; a cadence makes seven tenths of resolution, the chance of a tonic the rest."""
    own = spark.newSession()
    axes = "chromaticity double, brightness double, tension double, stability double, smoothness double, complexity double, resolution double, arrival int"
    own.createDataFrame([(1, 0, 0, "M:V", 0.0, 0.1, 0.2, 0.3, None, 0.0, None, 0), (1, 0, 1, "M:I", 0.0, 0.1, 0.2, 0.3, 0.5, 0.0, 0.95, 1), (1, 0, 2, "M:vi", 0.0, 0.1, 0.2, 0.3, 0.5, 0.0, 0.0, 0)], "song long, ordinal long, idx int, token string, " + axes).createOrReplaceTempView("color")
    own.createDataFrame([(1, 0, 0, 0.25, None), (1, 0, 1, 0.5, 0.4), (1, 0, 2, 0.0, 1.0)], "song long, ordinal long, idx int, p_token double, p_class double").createOrReplaceTempView("told")
    got = [(r["surprise"], r["resolution"], r["finality"]) for r in own.sql(T.query(K.expected_axes(), "SELECT * FROM color9 ORDER BY idx")).collect()]
    assert got[0] == (2.0, None, None)
    assert got[1] == pytest.approx((1.0, 0.7 * 0.95 + 0.3 * 0.4, 0.7 * 0.95 + 0.3 * 0.4))
    assert got[2] == pytest.approx((19.931568569, 0.3, 0.0))
    norms = {(r["axis"], r["subject_type"]): r for r in own.sql(T.query([*K.expected_axes(), *K.color_norms(T.SPARK)], "SELECT * FROM norms")).collect()}
    assert norms["surprise", "transition"]["count"] == 2 and norms["surprise", "chord"]["mean"] == 2.0 and ("smoothness", "chord") not in norms


def test_tonic_numerals(spark):
    tokens = {"M:I": True, "M:Imaj7": True, "m:i7": True, "M:vi7": True, "m:III": True, "M:V7/vi": False, "M:bVI": False, "M:viio7/ii": False, "M:iii": True, "m:bIII": False}
    got = spark.createDataFrame([(t,) for t in tokens], "token string").selectExpr("token", f"{K.tonic()} AS t").collect()
    assert {r["token"]: r["t"] for r in got} == tokens


def test_drivers_of_a_summary(spark):
    """The last chord, then each borrowed or else chromatic one; a chord can drive twice."""
    own = spark.newSession()
    own.createDataFrame([(1, 0, 0, "M:bVI", 1, 1, False), (1, 0, 1, "M:I", 0, 0, False), (1, 0, 2, "M:III", 0, 1, True), (2, 0, 0, "M:I", 0, 0, True)], "song long, ordinal long, idx int, token string, borrowed int, chromatic int, final boolean").createOrReplaceTempView("color")
    got = sorted((r["song"], r["idx"], r["reason"], r["weight"]) for r in own.sql(K.color_drivers()).collect())
    assert got == [(1, 0, "borrowed_chord", 1.5), (1, 2, "chromatic_chord", 1.0), (1, 2, "final_cadence", 2.0), (2, 0, "final_cadence", 2.0)]


def test_patterns_as_subjects(spark):
    """Patterns become progressions in the reference key; those of both modes, or with a token that can't be realized, stay out."""
    own = spark.newSession()
    own.createDataFrame([(1, 0, k, t) for k, t in enumerate(["M:I", "M:IV", "M:V", "M:I"])], "song long, ordinal long, pos long, token string").createOrReplaceTempView("roman")
    patterns = {"M:I M:IV M:V": 30, "M:I m:iv M:V": 40, "M:I M:? M:V": 50}
    own.createDataFrame(list(patterns.items()), "pattern string, support long").createOrReplaceTempView("rpats")
    spots = [(p, i, t) for p in patterns for i, t in enumerate(p.split())]
    own.createDataFrame(spots, "pattern string, pos int, token string").createOrReplaceTempView("rspots")
    tokens = [("major" if t[0] == "M" else "minor", t) for t in {t for _, _, t in spots}]
    own.createDataFrame(tokens, "mode string, token string").createOrReplaceTempView("some_tokens")
    steps = [C.QUALITY_DIM, T.DEGREE_DIM, *K.realized("some_tokens"), *K.subjects(patterns=True)]
    rows = own.sql(T.query(steps, "SELECT song, pos, root_pc, quality FROM pch WHERE song LIKE 'pattern%'")).collect()
    assert sorted((r["song"], r["pos"], r["root_pc"], r["quality"]) for r in rows) == [("pattern M:I M:IV M:V", 0, 0, "maj"), ("pattern M:I M:IV M:V", 1, 5, "maj"), ("pattern M:I M:IV M:V", 2, 7, "maj")]
    assert {r["subject_id"]: r["support"] for r in own.sql(T.query(steps, "SELECT subject_id, support FROM subj WHERE subject_type = 'pattern'")).collect()} == patterns
    assert [tuple(r) for r in own.sql(T.query(steps, "SELECT key_name, tonic, mode FROM pkeys WHERE song LIKE 'pattern%'")).collect()] == [("C major", 0, "major")]
