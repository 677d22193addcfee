"""Queries over chord lines: parsing, keys, numerals, relationships, functions and reports."""

from __future__ import annotations

from ..functions import chords as C
from ..operators import keys as Y
from ..operators import theory as T
from ..sources.fixtures import CHORD_SQL, chord_lines, clustered, isolated, materialize

_SECTION_KEYS = [*T.KEY_DIMS, *T.key_scores("ch", "skeys")]
#: The same in Spark: one aggregate for each section.
_WIDE_KEYS = [C.KEY_DIM, *T.key_scores_wide("ch", "skeys")]


def _ctes(d: T.Dialect, depth: str) -> list[str]:
    """What a depth needs: dim, keys, song, mods, roman, facts."""
    out = T.chord_dim(d)
    if depth in ("keys", "song", "mods", "roman", "facts"):
        out = [*out, *_SECTION_KEYS]
    if depth in ("song", "mods", "roman", "facts"):
        out = [*out, *T.song_keys(d)]
    if depth == "mods":
        out = [*out, *T.modulations()]
    if depth in ("roman", "facts"):
        out = [*out, *T.romanize()]
    if depth == "facts":
        out = [*out, *T.relationships(d)]
    return out


_LABELLED = "covered AS (SELECT DISTINCT song, ordinal, i FROM (SELECT song, ordinal, from_index AS i FROM facts UNION ALL SELECT song, ordinal, to_index - 1 AS i FROM facts))"
#: name: (depth, select in both dialects)
SPECS: dict[str, tuple[str, str]] = {
    "canonical_chords": ("dim", "SELECT symbol, ok, canon, quality, qclass, root_pc, bass_pc, mask, inversion, ext FROM chord_dim"),
    "display_chord": ("dim", "SELECT symbol, CASE WHEN ok THEN root || CASE quality WHEN 'maj' THEN '' WHEN 'min' THEN 'm' WHEN 'min7' THEN 'm7' WHEN 'minmaj7' THEN 'mMaj7' ELSE quality END || CASE WHEN bass_pc <> root_pc OR instr(canon, '/') > 0 THEN substr(canon, instr(canon, '/')) ELSE '' END END AS display FROM chord_dim"),
    "pitch_set_features": ("dim", "SELECT symbol, mask, bit_count(mask) AS tones, " + ", ".join(f"bit_count(mask & {T.rotated('mask', str(k))}) {'/ 2' if k == 6 else ''} AS ic{k}" for k in range(1, 7)).replace(" / 2 AS", " AS") + ", inversion, qclass, ext FROM chord_dim WHERE ok"),
    "salience": ("keys", "SELECT song, ordinal, pc, v AS weight FROM skeys_sal"),
    "estimate_keys": ("keys", T.best_keys("skeys")),
    "song_key": ("song", "SELECT song, ordinal, key_name, p FROM section_key"),
    "modulations": ("mods", "SELECT song, ordinal, from_key, to_key, semitones, chord_index FROM mods"),
    "key_eval": ("song", "SELECT count(*) AS sections, avg(CAST(CASE WHEN s.key_no = g.key_no THEN 0 ELSE 1 END AS DOUBLE)) AS disagreement, avg(CAST(CASE WHEN g.p >= 0.95 THEN 1 ELSE 0 END AS DOUBLE)) AS sure FROM section_key s JOIN song_key g ON g.song = s.song"),
    "romanize": ("roman", "SELECT song, ordinal, pos, key_name, core, figure, func, kind, applied_to, unresolved FROM roman"),
    "relationship_facts": ("facts", "SELECT song, ordinal, from_index, to_index, rule FROM facts"),
    "functions": ("roman", "SELECT canon AS chord, mode, token, count(*) AS count FROM roman GROUP BY canon, mode, token"),
    "support_by_function": ("roman", "SELECT mode, token, count(*) AS total FROM roman GROUP BY mode, token"),
}
# Legacy numerals by interval above the tonic.
_LEGACY = {"major": "I bII II bIII III IV bV V bVI VI bVII VII", "minor": "I bII II III #III IV bV V VI #VI VII #VII"}
_LEGACY_DIM = C.values("legacy_dim", "mode, iv, base", [(m, i, x) for m, row in _LEGACY.items() for i, x in enumerate(row.split())])
_LEGACY_ROWS = f"""{_LEGACY_DIM},
v1 AS (SELECT c.song, c.ordinal, c.pos, CASE WHEN substr(c.quality, 1, 3) = 'min' THEN lower(l.base) ELSE l.base END AS core, CASE c.quality WHEN 'maj7' THEN 'maj7' WHEN 'min7' THEN '7' WHEN '7' THEN '7' WHEN 'min7b5' THEN '7b5' ELSE '' END AS tail
  FROM ch c JOIN section_key k ON k.song = c.song AND k.ordinal = c.ordinal JOIN legacy_dim l ON l.mode = k.mode AND l.iv = (c.root_pc - k.tonic + 12) % 12)"""
# Legacy labels of pairs of numerals.
_LABELS = [("V", "I", "authentic cadence"), ("V", "I", "dominant resolution"), ("IV", "I", "plagal cadence"), ("iv", "I", "minor plagal cadence"), ("iv", "I", "modal interchange"), ("V", "vi", "deceptive cadence"),
  ("bII", "I", "tritone substitution"), ("bII", "I", "subV-like resolution"), *[(a, b, "chromatic mediant") for a, b in (("I", "bIII"), ("I", "bVI"), ("i", "III"), ("i", "VI"), ("bIII", "I"), ("bVI", "I"))],
  *[(a, b, "circle-of-fifths motion") for a, b in (("ii", "V"), ("II", "V"), ("V", "I"), ("vi", "ii"), ("VI", "ii"))]]
_LABEL_ROWS = _LEGACY_ROWS + ",\n" + C.values("label_dim", "a, b, label", _LABELS) + """,
v1p AS (SELECT song, ordinal, pos, core AS a, lead(core) OVER (PARTITION BY song, ordinal ORDER BY pos) AS b FROM v1)"""
_FOUND = {
    "v1_romanize": ("song", _LEGACY_ROWS, "SELECT song, ordinal, pos, core || tail AS numeral FROM v1"),
    "v1_labels": ("song", _LABEL_ROWS, "SELECT p.song, p.ordinal, p.pos, d.label FROM v1p p JOIN label_dim d ON d.a = p.a AND d.b = p.b"),
    "similar_chords": (
        "roman",
        """fu AS (SELECT canon AS chord, token, count(*) AS n, max(mask) AS mask FROM roman GROUP BY canon, token),
tot AS (SELECT chord, sum(n) AS n, CAST(sum(n * n) AS DOUBLE) AS nn, max(mask) AS mask FROM fu GROUP BY chord),
seed AS (SELECT chord, nn, mask FROM tot),
seed_fu AS (SELECT f.chord, f.token, f.n, row_number() OVER (PARTITION BY f.chord ORDER BY f.n DESC, f.token) AS r FROM fu f JOIN seed s ON s.chord = f.chord),
cand AS (SELECT DISTINCT s.chord AS seed, f.chord FROM seed_fu s JOIN fu f ON f.token = s.token WHERE s.r <= 4 AND f.chord <> s.chord),
dots AS (SELECT s.chord AS seed, f.chord, CAST(sum(s.n * f.n) AS DOUBLE) AS d FROM seed_fu s JOIN fu f ON f.token = s.token GROUP BY s.chord, f.chord)""",
        "SELECT c.seed, c.chord, 0.6 * bit_count(s.mask & t.mask) / bit_count(s.mask | t.mask) + 0.4 * d.d / sqrt(s.nn * t.nn) AS score FROM cand c JOIN seed s ON s.chord = c.seed JOIN tot t ON t.chord = c.chord JOIN dots d ON d.seed = c.seed AND d.chord = c.chord",
    ),
    "relationship_coverage": ("facts", _LABELLED, "SELECT (SELECT count(*) FROM covered) AS covered, (SELECT count(*) FROM rw WHERE b IS NOT NULL) AS transitions"),
    "abs_transitions": ("dim", "ab AS (SELECT canon AS from_chord, lead(canon) OVER (PARTITION BY song, ordinal ORDER BY pos) AS to_chord FROM ch)", "SELECT from_chord, to_chord, count(*) AS count FROM ab WHERE to_chord IS NOT NULL GROUP BY from_chord, to_chord HAVING count(*) >= 3"),
    "line_of_fifths": ("dim", C.KEY_PC_DIM, "SELECT c.symbol, k.key_name, k.note, k.lof, k.in_scale FROM chord_dim c JOIN key_pc_dim k ON k.pc = c.root_pc WHERE c.ok"),
}


_GRID = "SELECT point, CAST(w_profile AS DOUBLE) AS w_profile, CAST(w_fit AS DOUBLE) AS w_fit, CAST(w_final AS DOUBLE) AS w_final, CAST(temperature AS DOUBLE) AS temperature, top1, top2, ece, best FROM grid_eval"


def key_grid_search(spark, sf):
    """Grid points of the key score, held against the keys of the songs."""
    spark = isolated(spark)
    _staged(spark, sf, "salience")
    Y.grid_parts(spark.table("ch"), T.GRID).createOrReplaceTempView("grid_parts")
    g4 = "g4 AS (SELECT point, bin, sum(n) AS n, sum(p) / sum(n) AS p, sum(hits) / sum(n) AS top1, sum(hits) AS hits, sum(seconds) AS seconds FROM grid_parts GROUP BY point, bin)"
    ctes = T.key_grid("skeys_x", "song_key")
    return spark.sql(T.query([ctes[0], g4, *ctes[-2:]], _GRID))


def _parts(name: str, d: T.Dialect) -> tuple[list[str], str]:
    if name in SPECS:
        depth, select = SPECS[name]
        return _ctes(d, depth), select
    depth, more, select = _FOUND[name]
    known = _ctes(d, depth)
    return [*known, more.removeprefix(T.DEGREE_DIM + ",") if T.DEGREE_DIM in known else more], select


def _view(spark, name: str, ctes: list[str]) -> None:
    """The relation `name`, worked out once for all that reads it."""
    materialize(spark.sql(T.query(ctes, f"SELECT * FROM {name}")), name).createOrReplaceTempView(name)


def _clustered(spark, name: str, ctes: list[str], *order: str) -> None:
    """Like _view(), for relations that are dealt by song."""
    clustered(spark.sql(T.query(ctes, f"SELECT * FROM {name}")), name, *order).createOrReplaceTempView(name)


#: skeys (the two best keys of each section), song_key and section_key over all_keys, which Y.section_keys() makes.
_KEYS = {
    "skeys": "SELECT a.song, a.ordinal, k.*, a.n, a.last_pc, a.p, a.rk FROM (SELECT song, ordinal, n, last_pc, stack(2, best_no, best_p, 1, second_no, second_p, 2) AS (no, p, rk) FROM all_keys) a JOIN key_dim k ON k.key_no = a.no",
    "song_key": "SELECT song, any_value(song_no) AS key_no, any_value(song_p) AS p FROM all_keys GROUP BY song",
    "section_key": "SELECT a.song, a.ordinal, a.key_no, k.key_name, k.tonic, k.mode, a.p FROM all_keys a JOIN key_dim k ON k.key_no = a.key_no",
}


def _relation(spark, name: str, ctes: list[str], select: str | None = None) -> None:
    """A view that is worked out anew by each that reads it."""
    spark.sql(T.query(ctes, select or f"SELECT * FROM {name}")).createOrReplaceTempView(name)


def _staged(spark, sf, depth: str, stored: bool = False, best: bool = False) -> list[str]:
    """What a depth needs beyond the relations that earlier depths leave as views (lines, chord_dim, ch, skeys, section_key, song_key).

    Lines and keys are stored, dealt by song and in order, so whatever goes by song needs no shuffle from there on; a few columns tell chords, the rest is looked up
    in chord_dim. stored: roman is a stored view too, for those that read it more than once; best: skeys is there too.
    """
    clustered(chord_lines(spark, sf), "lines", "ordinal", "pos").createOrReplaceTempView("lines")
    dim = T.chord_dim(T.SPARK)
    _view(spark, "chord_dim", dim[:-1])
    if depth == "dim":
        return dim[-1:]
    _relation(spark, "ch", dim[-1:])
    if depth == "salience":
        return _WIDE_KEYS
    keys = Y.section_keys(spark.table("ch"))
    if depth == "keys":
        keys.createOrReplaceTempView("all_keys")
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        some = keys if best else keys.select("song", "ordinal", "song_no", "song_p", "key_no", "p")
        clustered(some.repartition(parts, "song"), "all_keys", "ordinal").createOrReplaceTempView("all_keys")
    for name, select in _KEYS.items():
        if name != "skeys" or best or depth == "keys":
            _relation(spark, name, [C.KEY_DIM], select)
    if depth in ("keys", "song", "mods"):
        return T.modulations() if depth == "mods" else []
    if not stored:
        return [*T.romanize(), *(T.relationships(T.SPARK) if depth == "facts" else [])]
    _clustered(spark, "roman", [*T.romanize()[:-1], T.romanize()[-1].replace("SELECT *,", f"SELECT {_KEPT},", 1)], "ordinal", "pos")
    return T.relationships(T.SPARK) if depth == "facts" else []


#: Columns of r3 that are read beyond roman.
_KEPT = "song, ordinal, section, genre, decade, pos, root_pc, bass_pc, mask, core, qclass, quality, inversion, canon, pmask, len, key_name, tonic, mode, degree, acc, kind, base, applied_to, role"


def _runner(name: str):
    def run(spark, sf):
        spark = isolated(spark)
        depth, *more, select = SPECS.get(name) or _FOUND[name]
        ctes = [*_staged(spark, sf, "salience" if name == "salience" else depth, name in _TWICE), *more]
        return spark.sql(T.query(ctes, select) if ctes else select)

    run.__name__ = name
    return run


#: Queries that read roman more than once.
_TWICE = ("similar_chords", "relationship_coverage")
NAMES = (*SPECS, *_FOUND)
QUERIES = {n: _runner(n) for n in NAMES}
ORACLE = {n: T.query([CHORD_SQL, *_parts(n, T.DUCK)[0]], _parts(n, T.DUCK)[1]) for n in NAMES}
QUERIES["key_grid_search"] = key_grid_search
ORACLE["key_grid_search"] = T.query([CHORD_SQL, *_ctes(T.DUCK, "song"), *T.key_grid("skeys_x", "song_key")], _GRID)
