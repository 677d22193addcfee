"""Constant tables of chord qualities, notes and keys, and what follows from them, as SQL value lists."""

from __future__ import annotations

# Intervals above the root of each chord quality, in stacking order.
QUALITIES = {
    "maj": (0, 4, 7), "min": (0, 3, 7), "maj7": (0, 4, 7, 11), "min7": (0, 3, 7, 10), "7": (0, 4, 7, 10), "dim": (0, 3, 6), "aug": (0, 4, 8),
    "sus2": (0, 2, 7), "sus4": (0, 5, 7), "7sus2": (0, 2, 7, 10), "7sus4": (0, 5, 7, 10), "add9": (0, 4, 7, 2), "add11": (0, 4, 7, 5), "add13": (0, 4, 7, 9),
    "minadd9": (0, 3, 7, 2), "minadd11": (0, 3, 7, 5), "min7b5": (0, 3, 6, 10), "no3": (0, 7), "9": (0, 4, 7, 10, 2), "maj9": (0, 4, 7, 11, 2),
    "maj7sus2": (0, 2, 7, 11), "maj9#11": (0, 4, 7, 11, 2, 6), "maj13": (0, 4, 7, 11, 2, 5, 9), "min9": (0, 3, 7, 10, 2), "11": (0, 4, 7, 10, 2, 5),
    "min11": (0, 3, 7, 10, 2, 5), "13": (0, 4, 7, 10, 2, 5, 9), "13b": (0, 4, 7, 10, 2, 5, 8), "min13": (0, 3, 7, 10, 2, 5, 9), "minadd13": (0, 3, 7, 9),
    "dim7": (0, 3, 6, 9), "augmaj7": (0, 4, 8, 11), "minmaj7": (0, 3, 7, 11),
}
# Spellings of a quality in addition to its own name.
ALIASES = {
    "": "maj", "major": "maj", "M": "maj", "minor": "min", "m": "min", "major7": "maj7", "M7": "maj7", "minor7": "min7", "m7": "min7", "+": "aug",
    "madd9": "minadd9", "madd11": "minadd11", "m7b5": "min7b5", "no3d": "no3", "M9": "maj9", "maj911s": "maj9#11", "m9": "min9", "m11": "min11", "m13": "min13",
    "madd13": "minadd13", "+maj7": "augmaj7", "mmaj7": "minmaj7",
}
# Labels of extensions by interval.
EXTENSIONS = {1: "b9", 2: "9", 3: "#9", 5: "11", 6: "#11", 8: "b13", 9: "13"}
# Weights of chord tones by position, and of the bass.
POSITION_WEIGHTS, BASS_WEIGHT = (1.0, 0.8, 0.5, 0.6, 0.3, 0.3, 0.3), 0.5
# Temperley's (1999) key profiles, and the calibrated weights of the key score.
PROFILES = {
    "major": (5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0),
    "minor": (5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0),
}
KEY_WEIGHTS = {"profile": 1.5, "fit": 1.0, "cadence": 0.0, "final": 0.6, "first": 0.2, "plagal": 0.8}
TEMPERATURE = 0.2
TONICS = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
FIFTHS = {"F": -1, "C": 0, "G": 1, "D": 2, "A": 3, "E": 4, "B": 5}
SCALES = {"major": (0, 2, 4, 5, 7, 9, 11), "minor": (0, 2, 3, 5, 7, 8, 10), "minor_union": (0, 2, 3, 5, 7, 8, 9, 10, 11)}
#: Notes with up to one accidental.
NOTES = {n + a: (pc + s) % 12 for n, pc in NATURALS.items() for a, s in (("", 0), ("#", 1), ("b", -1))}


def mask(tones) -> int:
    return sum(1 << t for t in {t % 12 for t in tones})


#: What a class needs of a chord's intervals; the first that fits names it. A chord without a third is suspended.
_CLASSES = (
    ("dim7", {3, 6, 9}), ("hdim7", {3, 6, 10}), ("min7", {3, 10}), ("minmaj7", {3, 11}), ("dom7", {4, 10}), ("maj7", {4, 11}), ("dim", {3, 6}), ("min", {3}), ("aug", {4, 8}), ("maj", {4}),
)


def quality_class(intervals: tuple[int, ...]) -> tuple[str, list[str]]:
    """Class, and labels of the tones beyond the triad that aren't the class's own."""
    tones = set(intervals)
    if tones == {0, 7}:
        return "power", []
    name, own = next(((n, need) for n, need in _CLASSES if need <= tones), ("sus", {10, 11}))
    return name, [EXTENSIONS[t] for t in intervals[3:] if t not in own and t in EXTENSIONS]


def suffix(quality: str) -> str:
    """What a numeral carries for the class of a quality."""
    name, _ = quality_class(QUALITIES[quality])
    if name == "sus":
        return "sus2" if QUALITIES[quality][1] == 2 else "sus4"
    return {"maj7": "maj7", "minmaj7": "maj7", "dim": "o", "hdim7": "h7", "dim7": "o7", "dom7": "7", "min7": "7", "aug": "+", "power": "5"}.get(name, "")


def fifths_note(index: int) -> str:
    """The note so many fifths above C."""
    sharps = (index + 1) // 7
    return "FCGDAEB"[(index + 1) % 7] + ("#" * sharps if sharps > 0 else "b" * -sharps)


def key_spelling(tonic: str, mode: str) -> list[tuple[int, str, int, bool]]:
    """pitch class, note, line-of-fifths index and whether it is in the scale, for the twelve pitch classes in a key.

    A scale is seven neighbours on the line of fifths, from one below the tonic of its relative major. Other tones are naturals, or
    else lie on the side of the key: sharps where that tonic is C or above it, flats below.
    """
    home = FIFTHS[tonic[0]] + 7 * (tonic.count("#") - tonic.count("b")) - (3 if mode == "minor" else 0)
    scale, naturals, side = range(home - 1, home + 6), range(-1, 6), range(6, 11) if home >= 0 else range(-6, -1)
    index = {7 * i % 12: i for i in (*side, *naturals, *scale)}
    return [(pc, fifths_note(index[pc]), index[pc], index[pc] in scale) for pc in range(12)]


def _literal(x) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """A common table expression of constants, for Spark and DuckDB alike."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS t({columns}))"


NOTE_DIM = values("note_dim", "note, pc", sorted(NOTES.items()))
ALIAS_DIM = values("alias_dim", "alias, quality", sorted({q: q for q in QUALITIES}.items() | ALIASES.items()))
QUALITY_DIM = values(
    "quality_dim", "quality, rel_mask, core_rel, qclass, suffix, ext, tones, t1, t2, t3",
    [(q, mask(t), mask(t[:3]), quality_class(t)[0], suffix(q), "".join(quality_class(t)[1]), len(set(t)), *[t[i] if i < len(t) else None for i in (1, 2, 3)]) for q, t in QUALITIES.items()],
)
TONE_DIM = values("tone_dim", "quality, place, step, weight", [(q, i, s, POSITION_WEIGHTS[min(i, 6)]) for q, t in QUALITIES.items() for i, s in enumerate(t)])
KEY_DIM = values("key_dim", "key_no, tonic, mode, key_name", [(2 * pc + k, pc, m, f"{TONICS[pc]} {m}") for pc in range(12) for k, m in enumerate(("major", "minor"))])
PROFILE_DIM = values("profile_dim", "mode, degree, w", [(m, i, w) for m, p in PROFILES.items() for i, w in enumerate(p)])
KEY_PC_DIM = values("key_pc_dim", "key_name, pc, note, lof, in_scale", [(f"{t} {m}", *r) for t in TONICS for m in ("major", "minor") for r in key_spelling(t, m)])
