"""Queries: voice leading, realised tokens, measured and perceived color. Each step is SQL for Spark and DuckDB alike; in Spark, what several steps read is stored."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import chords as C
from ..operators import color as K
from ..operators import likelihood as L
from ..operators import sequence as S
from ..operators import theory as T
from ..sources.fixtures import CHORD_SQL, CONTEXT_SQL, isolated, materialize
from .harmony import _clustered, _ctes, _relation, _staged, _view
from .prediction import CHAIN_SQL, STATS_SQL
from .sequences import KEPT_SQL, MIN_CONTEXT, NGRAM_SQL, PRUNE, pattern_sql, sql

_ABST = [
    "ab AS (SELECT canon AS from_chord, lead(canon) OVER (PARTITION BY song, ordinal ORDER BY pos) AS to_chord FROM ch)",
    "abst AS (SELECT from_chord, to_chord, count(*) AS count FROM ab WHERE to_chord IS NOT NULL GROUP BY from_chord, to_chord HAVING count(*) >= 3)",
]
_AXES = ", ".join(f"round({a}, 9) + 0e0 AS {a}" for a in K.MEASURED)
_LAST = "arc_end AS (SELECT a.song, a.ordinal, a.axis, round(a.value, 9) AS value, round(a.confidence, 9) + 0e0 AS confidence, a.source FROM arc a JOIN color c ON c.song = a.song AND c.ordinal = a.ordinal AND c.idx = a.idx WHERE c.final)"
SELECTS = {
    "voice_leading_edges": K.LEADING,
    "token_dim": "SELECT mode, token, iv AS interval_above_tonic, quality, root_pc, mask FROM token_dim",
    "color_axes": f"SELECT song, ordinal, idx, token, {_AXES} FROM color9",
    "color_norms": "SELECT axis, subject_type, count, " + ", ".join(f"round({x}, 9) + 0e0 AS {x}" for x in ("p05", "p25", "p50", "p75", "p95", "mean", "std")) + " FROM norms",
    "normalize_axes": "SELECT c.song, c.ordinal, c.idx, " + ", ".join(f"round(max(CASE WHEN n.axis = '{a}' AND c.{a} IS NOT NULL THEN {K.normalized(f'c.{a}')} END), 9) + 0e0 AS {a}" for a in K.MEASURED) + " FROM color9 c JOIN norms n ON n.subject_type = CASE WHEN c.idx = 0 THEN 'chord' ELSE 'transition' END GROUP BY c.song, c.ordinal, c.idx",
    "perceptual_axes": "SELECT * FROM arc_end",
    "color_arc": "SELECT song, ordinal, idx, axis, round(value, 9) AS value, round(confidence, 9) + 0e0 AS confidence, source FROM arc",
    "color_summary": K.color_summary(),
    "color_drivers": K.color_drivers(),
    "color_compare": "SELECT a.song, a.ordinal, a.axis, round(b.value - a.value, 9) + 0e0 AS delta FROM arc_end a JOIN arc_end b ON b.song = a.song AND b.ordinal = a.ordinal + 1 AND b.axis = a.axis",
    "color_profiles": "SELECT s.subject_type, s.subject_id, s.support, " + ", ".join(f"round(c.{a}, 9) + 0e0 AS {a}" for a in K.AXES) + " FROM subj s JOIN p_color c ON c.song = s.subject_type || ' ' || s.subject_id WHERE c.final",
    "color_profile_census": "SELECT s.subject_type, count(*) AS subjects, count(c.song) AS profiled, count(*) - count(c.song) AS skipped FROM subj s LEFT JOIN (SELECT song FROM p_color WHERE final) c ON c.song = s.subject_type || ' ' || s.subject_id GROUP BY s.subject_type",
}
#: How often a pattern of functions occurs at least: chords vary more than event types.
FUNCTION_SUPPORT = 4
_PROFILES = ("color_profiles", "color_profile_census")
_SPOTS = "rspots AS (SELECT pattern, unnest(string_split(pattern, ' ')) AS token, unnest(range(0, len(string_split(pattern, ' ')))) AS pos FROM rpats)"
#: DuckDB: rpats (pattern, support), the frequent patterns of roman, and rspots (pattern, token, pos); the steps to them are their own.
PATTERNS_SQL = [
    "rpats AS (" + sql("seq AS (SELECT song, ordinal, section, genre, decade, row_number() OVER (PARTITION BY song, ordinal ORDER BY pos) - 1 AS pos, token FROM roman)", CONTEXT_SQL, KEPT_SQL, pattern_sql(FUNCTION_SUPPORT), "SELECT pattern, support FROM pats") + ")",
    _SPOTS,
]
_NEED = {"color_axes": "color9", "color_norms": "norms", "normalize_axes": "norms", "perceptual_axes": "arc", "color_arc": "arc", "color_compare": "arc"}
_OWN = ("ch", "section_key", "r0", "r1", "r2", "r3", "roman", "cseq", "vpairs", "vbest", "vlead", "c1", "clof", "c2", "color", "vk", "vup", "vtri", "vall", "vset", "vrank", "vclose", "vroot", "vboth", "vone", "vopt")


def _renamed(ctes: list[str]) -> list[str]:
    """The steps for the profiles' own relations, p_*."""
    return [re.sub(r"\b(" + "|".join(_OWN) + r")\b(?! AS [a-z_]+[,)])", r"p_\1", x) for x in ctes]


def _profile_steps() -> list[str]:
    """p_color over subjects: numerals in the reference key, then the axes."""
    mine = [x for x in T.romanize() if x not in (T.DEGREE_DIM, T.DIATONIC_DIM, T.BORROWED_DIM)]
    voices = [x for x in K.voicings() if x != K._MIDI]
    color = [x for x in K.color_axes() if not x.startswith("ext_dim")]
    return _renamed(["ch AS (SELECT * FROM pch)", "section_key AS (SELECT * FROM pkeys)", *mine, *voices, *K.successive(), *K.motions(), *color])


def likelihood_sql(asked: str = "asked", classes: str = "kinds") -> list[str]:
    """likely: req, token, p for the relation asked (req, token), over ngrams, stats, chain and classes (token, class); what is not there is 0."""
    steps = "unnest(range(1, least(len(hist), CASE context WHEN 'global' THEN 4 ELSE 2 END) + 2))"
    return [
        'heads AS (SELECT context, "order" AS k, history, any_value(total) AS total, any_value(distinct_next) AS dn FROM ngrams GROUP BY ALL)',
        f"""lst AS (SELECT r.req, r.level, r.context, r.depth, r.k, r.history, h.total, t.d * h.dn / h.total AS share FROM (SELECT *, CASE WHEN k = 1 THEN '' ELSE array_to_string(hist[len(hist) - k + 2:], ' ') END AS history FROM (SELECT req, hist, level, context, len(hist) AS depth, {steps} AS k FROM chain)) r
  JOIN heads h ON h.context = r.context AND h.k = r.k AND h.history = r.history JOIN stats t ON t.context = r.context AND t."order" = r.k)""",
        """lw AS (SELECT *, coalesce(product(CASE WHEN k <= 3 THEN share ELSE 1 END) OVER w, 1) AS low, coalesce(product(share) OVER w, 1) AS whole, max(CASE WHEN k = least(depth, 2) + 1 THEN total ELSE 0 END) OVER (PARTITION BY req, level) AS n
  FROM lst WINDOW w AS (PARTITION BY req, level ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        "lb AS (SELECT req, level, CASE WHEN level = 3 THEN 1 ELSE any_value(n) / (any_value(n) + 100e0) END AS beta FROM lw GROUP BY req, level)",
        "lc AS (SELECT *, beta * coalesce(product(1 - beta) OVER (PARTITION BY req ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS weight, count(*) OVER (PARTITION BY req) AS levels FROM lb)",
        "lq AS (SELECT w.*, levels > 1 AND depth > 2 AS lifted, CASE WHEN levels = 1 THEN whole WHEN k <= 3 THEN weight * low ELSE 0 END AS wm, CASE WHEN level = 3 THEN whole ELSE 0 END AS wf, CASE WHEN level = 3 AND k <= 3 THEN low ELSE 0 END AS ws FROM lw w JOIN lc USING (req, level))",
        'own AS (SELECT context, "order" AS k, history, token, CASE WHEN "order" = 1 THEN cont / sum(cont) OVER (PARTITION BY context, "order", history) ELSE greatest(cnt - d, 0) / total END AS v FROM ngrams JOIN stats USING (context, "order"))',
        "aft AS (SELECT DISTINCT req, token FROM lq JOIN own USING (context, k, history) WHERE k > 3 AND lifted AND v > 0)",
        f"owns AS (SELECT context, k, history, token, v FROM own UNION ALL SELECT context, k, history, class, sum(v) FROM own JOIN {classes} USING (token) GROUP BY ALL)",
        f"pts AS (SELECT req, token FROM {asked} UNION SELECT req, token FROM aft)",
        "got AS (SELECT req, token, sum(wm * v) AS mix, sum(wf * v) AS wl, sum(ws * v) AS sh FROM pts JOIN lq USING (req) JOIN owns USING (context, k, history, token) GROUP BY ALL)",
        "rat AS (SELECT *, wl * greatest(mix, 1e-9) / greatest(sh, 1e-9) AS ratio FROM got)",
        "lng AS (SELECT req, sum(ratio) AS r, sum(mix) AS m FROM rat JOIN aft USING (req, token) GROUP BY req)",
        f"lngc AS (SELECT req, class AS token, sum(ratio) AS rt, sum(mix) AS mt FROM rat JOIN aft USING (req, token) JOIN {classes} USING (token) GROUP BY ALL)",
        "lgq AS (SELECT req, any_value(lifted) AS lifted, coalesce(product(CASE WHEN level = 3 AND k > 3 THEN share END), 1) AS lg FROM lq GROUP BY req)",
        f"""likely AS (SELECT req, token, CASE WHEN NOT lifted THEN mix ELSE CASE WHEN token IN (SELECT class FROM {classes}) THEN coalesce(rt, 0) + lg * (mix - coalesce(mt, 0)) ELSE ratio END / (coalesce(r, 0) + lg * (1 - coalesce(m, 0))) END AS p
  FROM rat JOIN lgq USING (req) LEFT JOIN lng USING (req) LEFT JOIN lngc USING (req, token))""",
    ]


_EXPECTED = [
    "seq AS (SELECT song, ordinal, section, genre, decade, idx AS pos, token FROM cseq)", CONTEXT_SQL, KEPT_SQL, NGRAM_SQL, STATS_SQL,
    "backs AS (SELECT song, ordinal, pos, token, genre, section, coalesce(list(token) OVER (PARTITION BY song, ordinal ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS before, list(token) OVER (PARTITION BY song, ordinal ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS upto FROM seq)",
    "asks AS (SELECT song, ordinal, pos, before AS hist, genre, section, token FROM backs UNION ALL SELECT song, ordinal, pos, upto, genre, section, '<T>' FROM backs WHERE pos > 0)",
    "asked AS (SELECT *, array_to_string(hist, ' ') || '|' || coalesce(genre, '') || '|' || coalesce(section, '') AS req FROM asks)",
    "reqs AS (SELECT DISTINCT req, hist, genre, section FROM asked)", CHAIN_SQL,
    f"kinds AS (SELECT DISTINCT token, '<T>' AS class FROM seq WHERE {K.tonic()})",
    *likelihood_sql(),
    "SELECT song, ordinal, pos AS idx, max(CASE WHEN token <> '<T>' THEN coalesce(p, 0) END) AS p_token, max(CASE WHEN token = '<T>' THEN coalesce(p, 0) END) AS p_class FROM asked LEFT JOIN likely USING (req, token) GROUP BY ALL",
]
#: DuckDB: told, over cseq; its steps are its own.
EXPECTED_SQL = ["told AS (" + sql(*_EXPECTED) + ")"]


def _duck(name: str) -> str:
    d = T.DUCK
    if name == "voice_leading_edges":
        ctes = [*_ctes(d, "dim"), C.TONE_DIM, *K.voicings(), *_ABST, *K.leading_targets(), *K.motions()]
    elif name == "token_dim":
        ctes = [*_ctes(d, "roman"), *K.realized("roman")]
    else:
        ctes = [*_ctes(d, "facts"), C.KEY_PC_DIM, K.QUALITY_EXT, *K.voicings(), *K.successive(), *K.motions(), *K.color_axes()]
        if name in _PROFILES:
            ctes += [*K.realized("roman"), *PATTERNS_SQL, *[x.replace("STRING", "VARCHAR") for x in K.subjects(patterns=True)], *_profile_steps()]
        if _NEED.get(name) in ("color9", "norms"):
            ctes += [*EXPECTED_SQL, *K.expected_axes(), *K.color_norms(d)]
        elif _NEED.get(name) == "arc":
            ctes += [*K.color_arc(d), _LAST]
    return T.query([CHORD_SQL, *ctes], SELECTS[name])


def _colored(spark, sf, facts: bool) -> None:
    """Views roman, color and, if asked, facts."""
    rules = _staged(spark, sf, "facts" if facts else "roman", stored=True)
    if facts:
        _relation(spark, "facts", rules)
    _relation(spark, "cseq", K.successive()[:1])
    _view(spark, "vpairs", K.successive()[1:])
    _view(spark, "vopt", [C.QUALITY_DIM, C.TONE_DIM, *K.voicings()])
    _view(spark, "vlead", K.motions())
    known, axes = [C.TONE_DIM, C.KEY_PC_DIM, K.QUALITY_EXT], K.color_axes()
    _view(spark, "clof", [*known, *axes[:2]])
    _clustered(spark, "color", [*known, *[x for x in axes if not x.startswith("clof AS")]], "ordinal", "idx")


def chord_model(spark, rows):
    """The sequence model of rows (song, ordinal, idx, token, genre, section, decade) of numerals."""
    return L.fit(rows.withColumn("pos", F.col("idx").cast("long")), MIN_CONTEXT, PRUNE, keep=materialize)


def _measured(spark) -> None:
    """View color9, over the views cseq and color."""
    rows = spark.table("cseq").select("song", "ordinal", "idx", "token", "genre", "section", "decade")
    classes = rows.select("token").distinct().filter(K.tonic()).withColumn("class", F.lit("<T>"))
    materialize(L.expected(rows, chord_model(spark, rows), classes, "<T>", keep=materialize), "told").createOrReplaceTempView("told")
    _view(spark, "color9", K.expected_axes())


def pattern_views(spark) -> None:
    """Views rpats and rspots over the view roman."""
    sections = spark.sql("SELECT song, ordinal, section, genre, decade, array_sort(collect_list(named_struct('pos', pos, 'token', token))).token AS tokens FROM roman GROUP BY song, ordinal, section, genre, decade")
    materialize(S.frequent_patterns(sections, FUNCTION_SUPPORT), "frequent").createOrReplaceTempView("rpats")
    spark.sql("SELECT pattern, x.pos, x.col AS token FROM rpats LATERAL VIEW posexplode(split(pattern, ' ')) x AS pos, col").createOrReplaceTempView("rspots")


def _profiled(spark, sf, patterns: bool = False) -> None:
    """Views roman, subj and p_color."""
    _staged(spark, sf, "roman", stored=True)
    if patterns:
        pattern_views(spark)
    known = [C.QUALITY_DIM, T.DEGREE_DIM, *K.realized("roman"), *K.subjects(patterns)]
    for relation in ("subj", "pch", "pkeys"):
        _view(spark, relation, known)
        known = [x for x in known if not x.startswith(("follow AS", "subj AS"))]
    _profile_views(spark)


def _profile_views(spark, only: tuple[str, ...] = ("p_roman", "p_vopt", "p_cseq", "p_vlead", "p_color")) -> None:
    """Views over the views pch and pkeys: p_color and what it needs, or those asked for."""
    steps = [C.QUALITY_DIM, C.TONE_DIM, C.KEY_PC_DIM, K.QUALITY_EXT, K._MIDI, "ext_dim AS (SELECT quality, n_ext FROM quality_ext)", T.DEGREE_DIM, T.DIATONIC_DIM, T.BORROWED_DIM, *_profile_steps()]
    at = next(i for i, x in enumerate(steps) if x.startswith("p_cseq AS"))
    voiced = [C.QUALITY_DIM, C.TONE_DIM, K._MIDI, *[x for x in steps[:at] if x.startswith(("p_ch ", "p_v"))]]
    known = {"p_roman": [x for x in steps[:at] if not x.startswith("p_v")], "p_vroot": voiced, "p_vopt": voiced, "p_cseq": [steps[at]], "p_vlead": steps[at + 1 : at + 4]}
    known["p_color"] = [C.TONE_DIM, C.KEY_PC_DIM, K.QUALITY_EXT, "ext_dim AS (SELECT quality, n_ext FROM quality_ext)", *steps[at + 4 :]]
    for relation in only:
        _view(spark, relation, known[relation])


def _compared() -> str:
    """Each section against the next of its song: rows of six axes for those that follow each other, without a join."""
    own = ", ".join(f"round({K.felt(a)['value']}, 9) AS {a}" for a in K.PERCEIVED)
    nxt = ", ".join(f"lead({a}) OVER (PARTITION BY song ORDER BY ordinal) AS n_{a}" for a in K.PERCEIVED)
    each = ", ".join(f"named_struct('axis', '{a}', 'delta', round(n_{a} - {a}, 9) + 0e0)" for a in K.PERCEIVED)
    return f"""SELECT song, ordinal, x.axis AS axis, x.delta AS delta FROM (SELECT song, ordinal, explode(array({each})) AS x FROM
  (SELECT *, lead(ordinal) OVER (PARTITION BY song ORDER BY ordinal) AS n_ordinal, {nxt} FROM (SELECT song, ordinal, {own} FROM arcw WHERE final) e) p WHERE n_ordinal = ordinal + 1) y"""


#: Spark: the same rows as SELECTS over arcw.
_ARCS = {
    "perceptual_axes": f"SELECT song, ordinal, axis, round(value, 9) AS value, round(confidence, 9) + 0e0 AS confidence, source FROM ({K.arc_of('(SELECT * FROM arcw WHERE final) q')}) a",
    "color_arc": f"SELECT song, ordinal, idx, axis, round(value, 9) AS value, round(confidence, 9) + 0e0 AS confidence, source FROM ({K.arc_of()}) a",
    "color_compare": _compared(),
}


def _spark(name: str):
    def run(spark, sf):
        spark = isolated(spark)
        if name == "voice_leading_edges":
            ctes = _staged(spark, sf, "dim")
            _view(spark, "ch", ctes)
            _view(spark, "vroot", [C.QUALITY_DIM, C.TONE_DIM, *K.voicings()])
            _view(spark, "vopt", [C.QUALITY_DIM, C.TONE_DIM, *K.voicings()])
            for step in (_ABST, K.leading_targets()[:2], K.leading_targets()[2:4], K.leading_targets()[4:], K.motions()):
                _view(spark, step[-1].split(" ", 1)[0], step)
            return spark.sql(SELECTS[name])
        if name == "token_dim":
            _staged(spark, sf, "roman")
            return spark.sql(T.query([C.QUALITY_DIM, T.DEGREE_DIM, *K.realized("roman")], SELECTS[name]))
        if name in _PROFILES:
            _profiled(spark, sf, patterns=True)
            return spark.sql(SELECTS[name])
        _colored(spark, sf, _NEED.get(name) == "arc")
        if _NEED.get(name) == "arc":
            return spark.sql(T.query(K.wide_arc(), _ARCS[name]))
        if name in _NEED:
            _measured(spark)
            return spark.sql(T.query(K.color_norms(T.SPARK), SELECTS[name]) if _NEED[name] == "norms" else SELECTS[name])
        return spark.sql(SELECTS[name])

    run.__name__ = name
    return run


QUERIES = {n: _spark(n) for n in SELECTS}
ORACLE = {n: _duck(n) for n in SELECTS}
