"""Chord parsing, keys and numerals on known cases."""

import pytest

from seqgraph.functions import chords as C
from seqgraph.operators import theory as T
from seqgraph.plans.harmony import _ctes

SCHEMA = "song long, ordinal long, section string, genre string, decade string, external_id string, pos long, symbol string"


def lines(spark, *progressions):
    rows = [(i, 0, "v", None, None, None, k, s) for i, p in enumerate(progressions) for k, s in enumerate(p.split())]
    return spark.createDataFrame(rows, SCHEMA)


def roman(spark, *progressions):
    got = T.run(lines(spark, *progressions), _ctes(T.SPARK, "roman"), "SELECT song, pos, key_name, figure, token, kind FROM roman").collect()
    return {(r["song"], r["pos"]): r for r in got}


@pytest.mark.parametrize(
    ("symbol", "canon"),
    [("C", "C:maj"), ("csus4", "C:sus4"), ("Cs", "C#:maj"), ("Bbm7/F", "Bb:min7/F"), ("F#m7b5", "F#:min7b5"), ("C/", "C:maj"), ("C/x", None), ("H?", None), ("Gmadd9", "G:minadd9"), ("Cweird", None), ("A+", "A:aug")],
)
def test_symbols(spark, symbol, canon):
    r = T.run(lines(spark, symbol), T.chord_dim(T.SPARK), "SELECT * FROM chord_dim").first()
    assert (r["canon"] if r["ok"] else None) == canon
    assert r["dangling"] == (symbol == "C/")


def test_quality_classes():
    assert C.quality_class(C.QUALITIES["min7b5"]) == ("hdim7", []) and C.quality_class(C.QUALITIES["13"]) == ("dom7", ["9", "11", "13"])
    assert C.quality_class(C.QUALITIES["add9"]) == ("maj", ["9"]) and C.quality_class(C.QUALITIES["no3"])[0] == "power" and C.quality_class(C.QUALITIES["7sus4"])[0] == "sus"


def test_spelling():
    notes = {pc: (n, lof) for pc, n, lof, _ in C.key_spelling("F#", "major")}
    assert notes[5] == ("E#", 11) and {pc: n for pc, n, _, _ in C.key_spelling("A", "minor")}[8] == "G#"


def test_numerals_are_the_same_in_all_keys(spark):
    r = roman(spark, "C Am F G7 C", "Eb Cm Ab Bb7 Eb", "C D7 G7 C C", "Am Dm E7 Am")
    assert [r[0, i]["figure"] for i in range(5)] == ["I", "vi", "IV", "V7", "I"]
    assert [r[1, i]["token"] for i in range(5)] == [r[0, i]["token"] for i in range(5)]
    assert r[2, 1]["figure"] == "V7/V" and r[2, 1]["kind"] == "secondary_dominant"
    assert [r[3, i]["token"] for i in range(4)] == ["m:i", "m:iv", "m:V7", "m:i"]


def test_relationships(spark):
    got = T.run(lines(spark, "C F G7 C"), _ctes(T.SPARK, "facts"), "SELECT from_index, rule FROM facts").collect()
    assert {(2, "authentic"), (0, "circle_fifths"), (2, "circle_fifths"), (1, "stepwise_bass")} <= {tuple(r) for r in got}
