"""Queries: candidates for the next function, their features, plausibility, intents and substitutes, the fit of plausibility and an evaluation.

The sequence model and the requests are DataFrames (operators.likelihood, operators.predict): it is fitted to the train split, and what is asked are the positions of
the test split (those of the dev split, for the fit). The rest is SQL for Spark and DuckDB alike; in Spark, what several steps read is stored.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chords as C
from ..operators import color as K
from ..operators import embed as E
from ..operators import likelihood as L
from ..operators import plausibility as W
from ..operators import predict as P
from ..operators import theory as T
from ..sources.fixtures import CHORD_SQL, CONTEXT_SQL, isolated, materialize
from .color import EXPECTED_SQL, _colored, _measured, _profile_steps, _profile_views, chord_model, likelihood_sql
from .embeddings import W_SQL, rp_sql
from .harmony import _ctes, _view
from .prediction import CHAIN_SQL, LIFT, SPLIT_SQL, STATS_SQL, TRAIN_SQL, plain_sql
from .reports import transition_views, transitions
from .sequences import KEPT_SQL, NGRAM_SQL, sql

#: Dimensions of the functions' vectors.
DIMS = 64
# The theory vocabulary by mode, the targets of applied chords, and the tokens that come right after the likeliest ones.
DIATONIC_FIGURES = {"M": "I ii iii IV V vi vii", "m": "i iio III iv V VI VII"}
MIXTURE_FIGURES = {"M": "iv bVI bVII bIII i iio bVImaj7", "m": "IV V7 bVI bVII I II"}
THIRD_FIGURES = {"M": "bIII bVI III VI", "m": "III VI bIII bVI"}
APPLIED_TO = {"M": "I ii iii IV V vi", "m": "i ii III iv V VI"}
_PRIORITY = ("ii", "iv", "vi", "bVII", "bVImaj7", "V7")
# Figures that count as borrowed by mode, and as mediants.
_AS_BORROWED = {"M": ("iv", "bVI", "bVII", "bIII", "i"), "m": ("IV", "V", "I", "II")}
_AS_MEDIANT = ("bIII", "bVI", "III", "VI")
# Weights of the plausibility of a candidate.
WEIGHTS = {
    "log_p_ngram": 6.37905905, "log_p_global_bigram": 0.0, "pmi": 0.0, "diatonic": -0.00807445, "borrowed": 0.10004037, "applied": -0.12870422, "tritone_sub": -0.00149751, "chromatic_mediant": -0.06545033,
    "vl_cost": 0.01355892, "common_tones": 0.08164877, "emb_cos": 0.0, "tonal_distance": -0.01193143, "surprise": -0.13866927, "genre_section_fit": 0.0, "graph_probability": 0.0, "delta_brightness": -0.10433905,
    "delta_tension": 0.00466596, "delta_surprise": -0.13866927, "delta_complexity": 0.02214662, "delta_resolution": 0.19406961, "delta_smoothness": -0.01355892,
}
# Shares of plausibility, intent and diversity by preset.
PRESETS = {"plausible": (0.85, 0.15, 0.02), "balanced": (0.60, 0.40, 0.04), "adventurous": (0.35, 0.65, 0.07)}
AXES = ("darker_brighter", "tense_relaxed", "common_surprising", "simple_complex", "resolved_open", "smooth", "dreamy")
#: Requests of the intent query: a name, a preset and the sliders.
INTENTS = [("brighter", "balanced", {"darker_brighter": 1.0}), ("calm", "plausible", {"tense_relaxed": 0.8, "smooth": 0.6}), ("bold", "adventurous", {"common_surprising": 0.7, "simple_complex": 0.5}), ("dreamy", "balanced", {"dreamy": 1.0, "resolved_open": -0.3}), ("plain", "balanced", {})]
_COLORS = ("brightness", "tension", "complexity", "resolution", "smoothness")
_d = K._d
_W = "PARTITION BY song, ordinal ORDER BY pos"


def _theory() -> list[tuple[str, str]]:
    rows = set()
    for m in "Mm":
        rows |= {(m, f"{m}:{f}") for f in f"{DIATONIC_FIGURES[m]} {MIXTURE_FIGURES[m]} {THIRD_FIGURES[m]}".split()}
        rows |= {(m, f"{m}:{x}/{t}") for t in APPLIED_TO[m].split() for x in ("V7", "viio7", "subV7")}
    return sorted(rows)


def _clip(x: str, low: float = -1.0, high: float = 1.0) -> str:
    return f"greatest({_d(low)}, least({_d(high)}, {x}))"


def _names(values: tuple[str, ...] | str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in (values.split() if isinstance(values, str) else values)) + ")"


def vocabulary() -> list[str]:
    """token_dim of all functions that occur and of the theory vocabulary (theory_dim), over roman."""
    return [C.values("theory_dim", "m, token", _theory()), "alltok AS (SELECT mode, token FROM roman UNION SELECT CASE m WHEN 'M' THEN 'major' ELSE 'minor' END, token FROM theory_dim)", *K.realized("alltok")]


def histories(requests: str = "reqs") -> list[str]:
    """hreq: req, h1 (the last token), h2 (the one before it, null if there is none) and the mode of the requests whose last chords can be realised."""
    return [f"hreq AS (SELECT r.req, r.h1, r.h2, substr(r.h1, 1, 1) AS m FROM {requests} r JOIN token_dim a ON a.token = r.h1 LEFT JOIN token_dim b ON b.token = r.h2 WHERE r.h2 IS NULL OR b.token IS NOT NULL)"]


def candidates(cap: int = 64) -> list[str]:
    """cand: req, token, ngram_p, graph_p, similarity, sources, place: the union of what the model, the graph, theory and similar functions give, in order.

    Over hreq, ngt (req, token, p, rk: the model's tokens by rank), rg (a, b, prob: the graph), sims (t1, t2, s, rk: nearest functions), theory_dim and token_dim.
    """
    return [
        "grt AS (SELECT r.req, g.b AS token, g.prob AS p, row_number() OVER (PARTITION BY r.req ORDER BY g.prob DESC, g.b) AS rk FROM hreq r JOIN rg g ON g.a = r.h1 WHERE substr(g.b, 1, 1) = r.m)",
        "emb AS (SELECT req, token, s, row_number() OVER (PARTITION BY req ORDER BY s DESC, token) AS rk FROM (SELECT n.req, s.t2 AS token, max(s.s) AS s FROM ngt n JOIN sims s ON s.t1 = n.token WHERE n.rk <= 5 AND s.rk <= 10 GROUP BY n.req, s.t2) z)",
        f"""offers AS (SELECT req, token, p, {_d(0.0)} AS g, CAST(NULL AS DOUBLE) AS s, 'ngram' AS source FROM ngt WHERE rk <= 30 UNION ALL SELECT req, token, {_d(0.0)}, p, CAST(NULL AS DOUBLE), 'graph' FROM grt WHERE rk <= 100 AND p >= 0.005
  UNION ALL SELECT r.req, t.token, {_d(0.0)}, {_d(0.0)}, CAST(NULL AS DOUBLE), 'theory' FROM hreq r JOIN theory_dim t ON t.m = r.m UNION ALL SELECT req, token, {_d(0.0)}, {_d(0.0)}, s, 'embedding' FROM emb WHERE rk <= 50)""",
        """cu AS (SELECT o.req, o.token, max(o.p) AS ngram_p, max(o.g) AS graph_p, max(o.s) AS similarity, max(CASE o.source WHEN 'embedding' THEN 1 ELSE 0 END) AS e, max(CASE o.source WHEN 'graph' THEN 1 ELSE 0 END) AS g, max(CASE o.source WHEN 'ngram' THEN 1 ELSE 0 END) AS n, max(CASE o.source WHEN 'theory' THEN 1 ELSE 0 END) AS t
  FROM offers o JOIN hreq r ON r.req = o.req JOIN token_dim d ON d.token = o.token WHERE substr(o.token, 1, 1) = r.m GROUP BY o.req, o.token)""",
        "cr AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY round(ngram_p, 12) DESC, token) AS rk FROM cu)",
        f"cb AS (SELECT *, CASE WHEN rk <= 16 THEN 0 WHEN substr(token, 3) IN {_names(_PRIORITY)} THEN 1 ELSE 2 END AS band FROM cr)",
        "ci AS (SELECT *, sum(g) OVER (PARTITION BY req, band ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gi, sum(e) OVER (PARTITION BY req, band ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vi FROM cb)",
        # what the graph and similarity found takes turns
        "co AS (SELECT *, CASE WHEN band = 2 AND g = 0 AND e = 0 THEN 3 ELSE band END AS part, CASE WHEN band < 2 OR (g = 0 AND e = 0) THEN rk ELSE least(CASE WHEN g = 1 THEN 2 * gi ELSE 1000000 END, CASE WHEN e = 1 THEN 2 * vi + 1 ELSE 1000000 END) END AS turn FROM ci)",
        f"""cand AS (SELECT * FROM (SELECT req, token, ngram_p, graph_p, similarity, CASE WHEN e = 1 THEN 'embedding ' ELSE '' END || CASE WHEN g = 1 THEN 'graph ' ELSE '' END || CASE WHEN n = 1 THEN 'ngram ' ELSE '' END || CASE WHEN t = 1 THEN 'theory' ELSE '' END AS sources,
  row_number() OVER (PARTITION BY req ORDER BY part, turn, rk) AS place FROM co) q WHERE place <= {cap})""",
    ]


def progressions(runs: str) -> list[str]:
    """pch, pkeys: runs of one to three functions (relation, a query of a, b) as progressions in the reference key."""
    return [
        f"hp AS ({runs})",
        "spos AS (SELECT CASE WHEN b IS NULL THEN a ELSE a || '>' || b END AS song, 0 AS pos, a AS token FROM hp UNION ALL SELECT a || '>' || b, 1, b FROM hp WHERE b IS NOT NULL)",
        f"pch AS (SELECT s.song, 0 AS ordinal, s.pos, t.mode AS key_mode, q.qclass, q.suffix, q.ext, 'root' AS inversion, t.root_pc, t.root_pc AS bass_pc, t.mask, {T.rotated('q.core_rel', 't.root_pc')} AS core, t.quality FROM spos s JOIN token_dim t ON t.token = s.token JOIN quality_dim q ON q.quality = t.quality)",
        "pkeys AS (SELECT DISTINCT c.song, c.ordinal, k.key_name, k.tonic, k.mode, CAST(1 AS DOUBLE) AS p FROM pch c JOIN reference_dim k ON k.mode = c.key_mode)",
    ]


_PAIRS = "SELECT h2 AS a, h1 AS b FROM hreq WHERE h2 IS NOT NULL UNION SELECT h1, CAST(NULL AS STRING) FROM hreq WHERE h2 IS NULL UNION SELECT r.h1, c.token FROM cand c JOIN hreq r ON r.req = c.req"


def features(corpus: bool = True) -> list[str]:
    """cf: req, token and the features of each candidate, over cand, hreq, p_color and token_dim; cl: with logit, p, z and whether it stays.

    With corpus, colors are normalised (norms) and the graph's shares (rg) and those of all functions (uni) count; without, raw colors are clipped and these features are empty.
    """
    bound = ", ".join(f"max(CASE WHEN axis = '{a}' THEN {q} END) AS {a}_{q}" for a in _COLORS for q in ("p05", "p95"))
    scaled = lambda t, a: f"coalesce(CASE WHEN {t}.{a} IS NULL THEN {_d(0.0)} WHEN m.{a}_p95 - m.{a}_p05 <= 0 THEN {_d(0.5)} ELSE {_clip(f'({t}.{a} - m.{a}_p05) / (m.{a}_p95 - m.{a}_p05)', 0.0)} END, {_d(0.0)})"
    plain = lambda t, a: f"coalesce({f'({_clip(f"{t}.{a}")} + 1) / 2' if a == 'brightness' else _clip(f'{t}.{a}', 0.0)}, {_d(0.0)})"
    level = scaled if corpus else plain
    delta = lambda a: _clip(f"{level('y', a)} - {level('x', a)}")
    base = "regexp_extract(substr(c.token, 3), '^((b|#)?(VII|VI|IV|III|II|I|V|vii|vi|iv|iii|ii|i|v))', 1)"
    applied = "instr(c.token, '/') > 0"
    borrowed = f"NOT {applied} AND ((r.m = 'M' AND {base} IN {_names(_AS_BORROWED['M'])}) OR (r.m = 'm' AND {base} IN {_names(_AS_BORROWED['m'])}))"
    flag = lambda x: f"CASE WHEN {x} THEN {_d(1.0)} ELSE {_d(0.0)} END"
    log = lambda x: f"ln(greatest({x}, {_d(1e-06)}))"
    surprise = _clip(f"-{log('c.ngram_p')} / ln({_d(2.0)}) / 16", 0.0)
    seen, alone = (f"coalesce(g.prob, {_d(0.0)})", f"coalesce(u.p, {_d(0.0)})") if corpus else (_d(0.0), _d(0.0))
    made = {
        "log_p_ngram": f"{log('c.ngram_p')} / 14", "log_p_global_bigram": f"{log(seen)} / 14",
        "pmi": _clip(f"ln(greatest({seen}, {_d(1e-06)}) / greatest({alone}, {_d(1e-06)})) / 6"),
        "diatonic": flag(f"NOT ({applied}) AND NOT ({borrowed}) AND y.chromatic = 0"), "borrowed": flag(borrowed), "applied": flag(applied), "tritone_sub": flag("substr(c.token, 3, 4) = 'subV'"),
        "chromatic_mediant": flag(f"NOT {applied} AND {base} IN {_names(_AS_MEDIANT)}"), "vl_cost": f"1 - {level('y', 'smoothness')}", "common_tones": "bit_count(d.mask & e.mask) / CAST(bit_count(d.mask) AS DOUBLE)",
        "emb_cos": f"coalesce(c.similarity, {_d(0.0)})", "tonal_distance": _clip("abs(d.lof - e.lof) / CAST(7 AS DOUBLE)", 0.0), "surprise": surprise, "genre_section_fit": _d(0.0), "graph_probability": "c.graph_p",
        **{f"delta_{a}": delta(a) for a in ("brightness", "tension")}, "delta_surprise": surprise, **{f"delta_{a}": delta(a) for a in ("complexity", "resolution", "smoothness")},
    }
    logit = " + ".join(f"{_d(w)} * {k}" for k, w in WEIGHTS.items() if w)
    of = "PARTITION BY req"
    more = "LEFT JOIN rg g ON g.a = r.h1 AND g.b = c.token LEFT JOIN uni u ON u.token = c.token CROSS JOIN nm m" if corpus else ""  # nm is one row
    known = [
        f"nm AS (SELECT {bound} FROM norms WHERE subject_type = 'transition')",
        "uni AS (SELECT token, n / CAST(sum(n) OVER (PARTITION BY 1) AS DOUBLE) AS p FROM (SELECT token, count(*) AS n FROM roman GROUP BY token) q)",
    ]
    return [
        *(known if corpus else []),
        "cf AS (SELECT c.req, c.token, c.place, " + ", ".join(f"{x} AS {k}" for k, x in made.items()) + """ FROM cand c JOIN hreq r ON r.req = c.req JOIN token_dim d ON d.token = c.token JOIN token_dim e ON e.token = r.h1
  JOIN p_color x ON x.song = CASE WHEN r.h2 IS NULL THEN r.h1 ELSE r.h2 || '>' || r.h1 END AND x.final JOIN p_color y ON y.song = r.h1 || '>' || c.token AND y.idx = 1 """ + more + ")",
        f"cx AS (SELECT *, {logit} AS logit FROM cf)",
        f"cs AS (SELECT *, exp(logit - max(logit) OVER ({of})) AS ex, avg(logit) OVER ({of}) AS mid, stddev_pop(logit) OVER ({of}) AS spread, count(*) OVER ({of}) AS size FROM cx)",
        f"cp AS (SELECT *, ex / sum(ex) OVER ({of}) AS p, row_number() OVER ({of} ORDER BY round(logit, 12), token DESC) AS low FROM cs)",
        # the lowest twentieth of the candidates goes
        f"cl AS (SELECT *, (logit - mid) / CASE WHEN spread > 0 THEN spread ELSE 1 END AS z FROM cp WHERE low > greatest(0, ceil(size * {_d(0.05)}) - 1))",
    ]


def _score(i: str = "i") -> str:
    """The score of a candidate (c, of cl) for the sliders and preset of a row of intent_dim."""
    incoming = _clip("1 - c.vl_cost", 0.0)
    major7 = "CASE WHEN substr(c.token, length(c.token) - 3) = 'maj7' AND instr(c.token, '/') = 0 THEN 1 ELSE 0 END"
    aim = {
        "darker_brighter": f"c.delta_brightness - {_d(0.4)} * c.borrowed * (1 + c.chromatic_mediant)", "tense_relaxed": "-c.delta_tension", "common_surprising": "c.delta_surprise", "simple_complex": "c.delta_complexity", "resolved_open": "-c.delta_resolution", "smooth": "c.delta_smoothness",
        "dreamy": f"{_d(0.75)} * c.borrowed * c.chromatic_mediant * {major7} + {_d(0.15)} * {incoming} + {_d(0.1)} * greatest({_d(0.0)}, -c.delta_tension)",
    }
    intent = " + ".join(f"CAST({i}.{a} AS DOUBLE) * ({x})" for a, x in aim.items())
    magnitude = " + ".join(f"abs(CAST({i}.{a} AS DOUBLE))" for a in AXES)
    return f"CAST({i}.w_p AS DOUBLE) * c.z + 6 * CAST({i}.w_i AS DOUBLE) * ({intent}) / greatest({_d(1.0)}, {magnitude}) + CAST({i}.w_d AS DOUBLE) * ((1 - c.common_tones) / 2 + c.tonal_distance / 2) + CASE WHEN {i}.preset = 'adventurous' THEN {_d(0.08)} * c.surprise ELSE {_d(0.0)} END"


_INTENT_DIM = C.values("intent_dim", "name, preset, w_p, w_i, w_d, " + ", ".join(AXES), [(n, p, *PRESETS[p], *(float(x.get(a, 0.0)) for a in AXES)) for n, p, x in INTENTS])
SELECTS = {
    "candidate_sources": "SELECT req, token, round(ngram_p, 9) AS ngram_p, round(graph_p, 9) AS graph_p, similarity, trim(sources) AS sources, place FROM cand",
    "candidate_features": "SELECT req, token, " + ", ".join(f"round({k}, 9) + 0e0 AS {k}" for k in WEIGHTS) + " FROM cf",
    "candidate_plausibility": "SELECT req, token, round(logit, 9) + 0e0 AS logit, round(p, 9) AS p, round(z, 9) + 0e0 AS z FROM cl",
    "intent_score": f"SELECT i.name AS intent, c.req, c.token, round({_score()}, 9) + 0e0 AS score FROM cl c CROSS JOIN intent_dim i",
    # for a chord between two others: likelihood on both sides, the same function, and little motion
    "substitutes": "SELECT req, o, r, keep_function, smooth, surprising, token, score, motion, rank FROM sranked WHERE rank <= 10",
    "recommend_eval": "SELECT metric, round(value, 9) + 0e0 AS value FROM report",
}


def plain_candidates(cap: int) -> list[str]:
    """cand from the model and theory alone, as fit and evaluation take them: the likeliest tokens, then the priority ones, then the rest."""
    return [
        "cu AS (SELECT r.req, x.token, max(x.p) AS ngram_p FROM (SELECT req, token, p FROM ngt WHERE rk <= 30 UNION ALL SELECT h.req, t.token, 0e0 FROM hreq h JOIN theory_dim t ON t.m = h.m) x JOIN hreq r ON r.req = x.req JOIN token_dim d ON d.token = x.token WHERE substr(x.token, 1, 1) = r.m GROUP BY r.req, x.token)",
        "cr AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY round(ngram_p, 12) DESC, token) AS rk FROM cu)",
        f"co AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY CASE WHEN rk <= 16 THEN 0 WHEN substr(token, 3) IN {_names(_PRIORITY)} THEN 1 ELSE 2 END, rk) AS place FROM cr)",
        f"cand AS (SELECT req, token, ngram_p, {_d(0.0)} AS graph_p, CAST(NULL AS DOUBLE) AS similarity, place FROM co WHERE place <= {cap})",
    ]


def substitutes() -> list[str]:
    """sranked: over sreq (sid, req, l, o, r, keep_function, smooth, surprising), ngt, sright (sid, token, p: of r after the token), p_roman, p_vroot and cand (24 candidates for each req)."""
    moved = " + ".join(f"abs(a.{n} - b.{n})" for n in ("b", "u0", "u1", "u2"))
    log = lambda x: f"ln(greatest({x}, {_d(1e-09)}))"
    return [
        "sfunc AS (SELECT song AS token, func FROM p_roman WHERE len = 1)",
        "svoice AS (SELECT t.token, v.b, v.u0, v.u1, v.u2 FROM p_vroot v JOIN token_dim t ON t.quality = v.quality AND t.root_pc = v.root_pc AND v.bass_pc = v.root_pc)",
        "sall AS (SELECT s.sid, c.token, FALSE AS own FROM sreq s JOIN cand c ON c.req = s.req WHERE c.token <> s.o AND substr(c.token, 1, 1) = substr(s.o, 1, 1) UNION ALL SELECT sid, o, TRUE FROM sreq)",
        f"sin AS (SELECT x.sid, x.token, {moved} AS cost FROM sall x JOIN sreq s ON s.sid = x.sid JOIN svoice a ON a.token = s.l JOIN svoice b ON b.token = x.token)",
        f"sout AS (SELECT x.sid, x.token, {moved} AS cost FROM sall x JOIN sreq s ON s.sid = x.sid JOIN svoice a ON a.token = x.token JOIN svoice b ON b.token = s.r)",
        "smove AS (SELECT x.sid, x.token, x.own, i.cost + coalesce(u.cost, 0) AS motion FROM sall x JOIN sin i ON i.sid = x.sid AND i.token = x.token LEFT JOIN sout u ON u.sid = x.sid AND u.token = x.token)",
        f"""sscore AS (SELECT s.sid, s.req, s.o, s.r, s.keep_function, s.smooth, s.surprising, m.token, m.motion, {log(f'coalesce(n.p, {_d(0.0)})')} + CASE WHEN s.r IS NULL THEN {_d(0.0)} ELSE {log(f'coalesce(w.p, {_d(0.0)})')} END
  + CASE WHEN f.func = g.func THEN {_d(0.75)} ELSE {_d(0.0)} END - {_d(0.025)} * m.motion - CASE WHEN s.surprising THEN {_d(0.15)} * {log(f'coalesce(n.p, {_d(0.0)})')} ELSE {_d(0.0)} END AS score
  FROM smove m JOIN sreq s ON s.sid = m.sid JOIN smove k ON k.sid = m.sid AND k.own JOIN sfunc f ON f.token = m.token JOIN sfunc g ON g.token = s.o LEFT JOIN ngt n ON n.req = s.req AND n.token = m.token AND n.rk <= 100 LEFT JOIN sright w ON w.sid = s.sid AND w.token = m.token
  WHERE NOT m.own AND (NOT s.keep_function OR f.func = g.func) AND (NOT s.smooth OR m.motion <= k.motion + 3))""",
        "sranked AS (SELECT req, o, r, keep_function, smooth, surprising, token, round(score, 9) + 0e0 AS score, CAST(motion AS BIGINT) AS motion, row_number() OVER (PARTITION BY sid ORDER BY round(score, 9) DESC, token) AS rank FROM sscore)",
    ]


#: What the evaluation asks for: an intent's sliders, the color they should move and which way.
BENCHMARK = [("darker", {"darker_brighter": -1.0}, "brightness", -1), ("brighter", {"darker_brighter": 1.0}, "brightness", 1), ("surprising", {"common_surprising": 1.0}, "surprise", 1), ("smoother", {"smooth": 1.0}, "smoothness", 1)]
BENCHMARKED = 30
_EVAL_DIM = C.values("intent_dim", "name, preset, w_p, w_i, w_d, " + ", ".join(AXES), [(n, p, *PRESETS[p], *(float(x.get(a, 0.0)) for a in AXES)) for n, p, x in [("plain", "plausible", {}), ("neutral", "balanced", {}), *[(n, "balanced", x) for n, x, _, _ in BENCHMARK]]])


def scored_queries() -> list[str]:
    """squery: query (intent and req), token, score, mask of the candidates of cl: all requests for the plain ranking, those of bench (req) for the intents."""
    return [f"squery AS (SELECT i.name || ' ' || c.req AS query, c.token, round({_score()}, 9) + 0e0 AS score, CAST(t.mask AS INT) AS mask FROM cl c JOIN token_dim t ON t.token = c.token LEFT JOIN bench b ON b.req = c.req JOIN intent_dim i ON i.name = 'plain' OR b.req IS NOT NULL)"]


def evaluation() -> list[str]:
    """report: metric, value; over held (req, actual, n), bench, cx and cl, and picked (query, rank, token: candidates in order, unlike ones first)."""
    rate = lambda n, axis, way: f"""SELECT 'intent_{n}' AS metric, avg(CASE WHEN {way} * (i.d - u.d) > 1e-9 THEN 1e0 ELSE 0e0 END) AS value FROM five i JOIN five u ON u.req = i.req AND u.name = 'neutral' AND u.axis = i.axis WHERE i.name = '{n}' AND i.axis = '{axis}'"""
    axes = sorted({a for _, _, a, _ in BENCHMARK})
    five = " UNION ALL ".join(f"SELECT p.req, p.name, '{a}' AS axis, sum(c.delta_{a}) / 5 AS d FROM place p JOIN cx c ON c.req = p.req AND c.token = p.token WHERE p.rank <= 5 AND p.name <> 'plain' GROUP BY p.req, p.name" for a in axes)
    return [
        "place AS (SELECT substr(query, 1, instr(query, ' ') - 1) AS name, substr(query, instr(query, ' ') + 1) AS req, rank, token FROM picked)",
        "bymodel AS (SELECT req, token, row_number() OVER (PARTITION BY req ORDER BY round(log_p_ngram, 12) DESC, token) AS rank FROM cx)",
        "asked AS (SELECT h.req, h.actual, h.n, m.rank AS by_model, p.rank AS by_logit FROM held h JOIN hreq r ON r.req = h.req LEFT JOIN bymodel m ON m.req = h.req AND m.token = h.actual LEFT JOIN place p ON p.req = h.req AND p.token = h.actual AND p.name = 'plain')",
        "fresh AS (SELECT p.req, count(*) AS n FROM place p JOIN bymodel m ON m.req = p.req AND m.token = p.token WHERE p.name = 'plain' AND p.rank <= 5 AND m.rank > 5 GROUP BY p.req)",
        f"five AS ({five})",
        """told AS (SELECT 'n' AS metric, CAST(sum(n) AS DOUBLE) AS value FROM asked UNION ALL SELECT 'ngram_mrr', sum(n * coalesce(1e0 / by_model, 0e0)) / sum(n) FROM asked UNION ALL SELECT 'hybrid_mrr', sum(n * coalesce(1e0 / by_logit, 0e0)) / sum(n) FROM asked
  UNION ALL SELECT 'coverage_baseline', CAST(count(DISTINCT token) AS DOUBLE) FROM bymodel WHERE rank <= 5 UNION ALL SELECT 'coverage_hybrid', CAST(count(DISTINCT token) AS DOUBLE) FROM place WHERE name = 'plain' AND rank <= 5
  UNION ALL SELECT 'novel_top5_per_query', sum(a.n * coalesce(f.n, 0) * 1e0) / sum(a.n) FROM asked a LEFT JOIN fresh f ON f.req = a.req UNION ALL """ + " UNION ALL ".join(rate(n, a, w) for n, _, a, w in BENCHMARK) + ")",
        # the gates that published weights must pass
        """gate AS (SELECT max(CASE metric WHEN 'n' THEN value END) AS n, max(CASE metric WHEN 'ngram_mrr' THEN value END) AS a, max(CASE metric WHEN 'hybrid_mrr' THEN value END) AS b, max(CASE metric WHEN 'coverage_baseline' THEN value END) AS c, max(CASE metric WHEN 'coverage_hybrid' THEN value END) AS d,
  max(CASE metric WHEN 'novel_top5_per_query' THEN value END) AS e, min(CASE WHEN substr(metric, 1, 7) = 'intent_' THEN value END) AS f FROM told)""",
        "report AS (SELECT metric, value FROM told UNION ALL SELECT 'gate_mrr', CASE WHEN n > 0 AND b >= a - 0.02e0 THEN 1e0 ELSE 0e0 END FROM gate UNION ALL SELECT 'gate_coverage', CASE WHEN d > c THEN 1e0 ELSE 0e0 END FROM gate UNION ALL SELECT 'gate_novelty', CASE WHEN e > 0 THEN 1e0 ELSE 0e0 END FROM gate UNION ALL SELECT 'gate_intent', CASE WHEN f >= 0.8e0 THEN 1e0 ELSE 0e0 END FROM gate)",
    ]


# ---- DuckDB --------------------------------------------------------------------------------------------------------

_KEY = "array_to_string(hist, ' ') || '|' || coalesce(genre, '') || '|' || coalesce(section, '')"
MODEL_SQL = ["seq0 AS (SELECT song, ordinal, section, genre, decade, idx AS pos, token FROM cseq)", SPLIT_SQL, TRAIN_SQL, CONTEXT_SQL, KEPT_SQL, NGRAM_SQL, STATS_SQL]
_ASKED = f"askedpos AS (SELECT *, {_KEY} AS req, song || ':' || ordinal || ':' || pos AS place FROM (SELECT song, ordinal, pos, token, lead(token) OVER (PARTITION BY song, ordinal ORDER BY pos) AS r, genre, section, list(token) OVER (PARTITION BY song, ordinal ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hist FROM seq0 JOIN spl USING (song) WHERE split = 'test') WHERE pos >= 1)"
_HELD = "held AS (SELECT req, token AS actual, count(*) AS n FROM askedpos GROUP BY ALL)"
_NGT = "ngt AS (SELECT req, token, p, row_number() OVER (PARTITION BY req ORDER BY round(p, 12) DESC, token) AS rk FROM {0})"
_REQS = "reqs AS (SELECT DISTINCT req, hist, genre, section, hist[-1] AS h1, CASE WHEN len(hist) > 1 THEN hist[-2] END AS h2 FROM askedpos)"
_SIMS = "sims AS (" + sql(
    "ed AS (SELECT a AS src, b AS dst, count FROM rg)", W_SQL, rp_sql(DIMS),
    "SELECT t1, t2, s, row_number() OVER (PARTITION BY t1 ORDER BY s DESC, t2) AS rk FROM (SELECT x.token AS t1, y.token AS t2, round(sum(x.value * y.value), 9) AS s FROM rp x JOIN rp y ON x.dim = y.dim AND x.token <> y.token AND substr(x.token, 1, 1) = substr(y.token, 1, 1) GROUP BY ALL) z",
) + ")"
_RG = "rg AS (SELECT a, b, count, prob FROM rtr WHERE context = 'global')"


def greedy_sql(name: str, src: str, k: int) -> str:
    """name: query, rank, token of src (query, token, score, mask): at each step the score less 0.8 times the largest overlap with those chosen."""
    jac = "coalesce(bit_count(x.mask & m) / nullif(bit_count(x.mask | m), 0), 0)"
    return f"""{name}_l AS (SELECT query, list({{'token': token, 'score': score, 'mask': mask}}) AS c FROM {src} GROUP BY query),
{name}_s AS (SELECT query, c, CAST([] AS VARCHAR[]) AS tokens, CAST([] AS INT[]) AS masks, 0 AS k FROM {name}_l
  UNION ALL SELECT query, c, list_append(tokens, best.token), list_append(masks, best.mask), k + 1 FROM (SELECT *, list_sort([{{'w': -(x.score - 0.8e0 * coalesce(list_max([{jac} FOR m IN masks]), 0)), 'token': x.token, 'mask': x.mask}} FOR x IN c IF NOT list_contains(tokens, x.token)])[1] AS best FROM {name}_s WHERE k < {k} AND len(tokens) < len(c))),
{name} AS (SELECT query, unnest(range(1, len(tokens) + 1)) AS rank, unnest(tokens) AS token FROM (SELECT query, arg_max(tokens, k) AS tokens FROM {name}_s GROUP BY query))"""


def _duck(name: str) -> str:
    d = T.DUCK
    ctes = [*_ctes(d, "roman"), C.KEY_PC_DIM, K.QUALITY_EXT, *K.voicings(), *K.successive(), *K.motions(), *K.color_axes()]
    if name in ("candidate_features", "candidate_plausibility", "intent_score"):
        ctes += [*EXPECTED_SQL, *K.expected_axes(), *K.color_norms(d)]
    ctes += [*vocabulary(), *MODEL_SQL, _ASKED]
    if name == "substitutes":
        ctes += [
            "reqs AS (SELECT DISTINCT array_to_string(hist, ' ') || '||' AS req, hist, hist[-1] AS h1, CAST(NULL AS VARCHAR) AS h2 FROM askedpos)", *histories(), "lchain AS (SELECT req, hist, 3 AS level, 'global' AS context FROM reqs)", *plain_sql("fwd", 5, "lchain"), _NGT.format("fwd"), *plain_candidates(24),
            "sreq AS (SELECT *, row_number() OVER () AS sid FROM (SELECT DISTINCT array_to_string(p.hist, ' ') || '||' AS req, p.hist, p.hist[-1] AS l, p.token AS o, p.r, p.pos % 2 = 0 AS keep_function, p.pos % 3 = 0 AS smooth, p.pos % 5 = 0 AS surprising FROM askedpos p JOIN token_dim a ON a.token = p.hist[-1] JOIN token_dim b ON b.token = p.token LEFT JOIN token_dim c ON c.token = p.r WHERE p.r IS NULL OR c.token IS NOT NULL))",
            "sask AS (SELECT s.sid, c.token AS cand, list_append(s.hist, c.token)[-4:] AS hist, s.r AS token FROM sreq s JOIN cand c ON c.req = s.req WHERE s.r IS NOT NULL)", "asked AS (SELECT *, array_to_string(hist, ' ') || '||' AS req FROM sask)",
            "chain AS (SELECT DISTINCT req, hist, 3 AS level, 'global' AS context FROM asked)", "kinds AS (SELECT token, token AS class FROM seq WHERE FALSE)", *likelihood_sql(), "sright AS (SELECT a.sid, a.cand AS token, k.p FROM asked a JOIN likely k ON k.req = a.req AND k.token = a.token)",
            *progressions("SELECT token AS a, CAST(NULL AS VARCHAR) AS b FROM cand UNION SELECT l, NULL FROM sreq UNION SELECT o, NULL FROM sreq UNION SELECT r, NULL FROM sreq WHERE r IS NOT NULL"), *_profile_steps(), *substitutes(),
        ]
        return T.query([CHORD_SQL, *ctes], SELECTS[name])
    ctes += [*transitions(d), _RG, _HELD, _REQS, CHAIN_SQL, *LIFT, *histories(), _NGT.format("dist")]
    if name == "recommend_eval":
        ctes += [*plain_candidates(30), *progressions(_PAIRS), *_profile_steps(), *features(False), f"bench AS (SELECT DISTINCT req FROM (SELECT req FROM askedpos JOIN hreq USING (req) ORDER BY md5('{BENCH_SEED}:' || place), place LIMIT {BENCHMARKED}))", _EVAL_DIM, *scored_queries(), greedy_sql("picked", "squery", 30), *evaluation()]
        return T.query([CHORD_SQL, *ctes], SELECTS[name]).replace("WITH", "WITH RECURSIVE", 1)
    ctes += [_SIMS, *candidates()]
    if name != "candidate_sources":
        ctes += [*progressions(_PAIRS), *_profile_steps(), *features(), _INTENT_DIM]
    return T.query([CHORD_SQL, *ctes], SELECTS[name])


#: Seed of the positions that the intents are tried on.
BENCH_SEED = 53


# ---- Spark ---------------------------------------------------------------------------------------------------------


class _Asked:
    """The model of the train split, the asked positions of a split, and their requests; views hreq, ngt, theory_dim's tokens."""

    def __init__(self, spark, split: str = "test", contexts: bool = True):
        rows = spark.table("cseq").select("song", "ordinal", "idx", "token", "genre", "section", "decade").withColumn("split", P.assign_split(F.col("song")))
        self.model = chord_model(spark, rows.filter("split = 'train'"))
        held = rows.filter(F.col("split") == split).withColumn("r", F.lead("token").over(Window.partitionBy("song", "ordinal").orderBy("idx"))).withColumn("pos", F.col("idx").cast("long"))
        places = held.select(F.concat_ws(":", "song", "ordinal", "pos").alias("place"), "pos", "r")
        if not contexts:
            held = held.withColumn("genre", F.lit(None).cast("string")).withColumn("section", F.lit(None).cast("string"))
        self.positions = materialize(P.held_positions(held).join(places, "place"), "asked")
        ends = {"h1": F.element_at("hist", -1), "h2": F.try_element_at("hist", F.lit(-2))}
        self.requests = materialize(self.positions.select("req", "hist", "genre", "section").distinct().withColumns(ends), "requests")
        self.requests.createOrReplaceTempView("reqs")
        for relation in ("theory_dim", "token_dim"):
            _view(spark, relation, [C.QUALITY_DIM, T.DEGREE_DIM, *vocabulary()])
        _view(spark, "hreq", histories())
        known = self.requests.join(spark.table("hreq").select("req"), "req", "left_semi")
        p = P.distribution(materialize(self.model.evidence(known), "evidence"))
        by = Window.partitionBy("req").orderBy(F.desc(F.round("p", 12)), "token")
        materialize(p.withColumn("rk", F.row_number().over(by)), "ngt").createOrReplaceTempView("ngt")


def _graph(spark) -> None:
    """Views rg and sims: the global graph, and the functions nearest to each by vectors of it."""
    transition_views(spark)
    _view(spark, "rg", [_RG])
    v = materialize(E.fastrp(spark.sql("SELECT a AS src, b AS dst, count FROM rg"), DIMS), "function-vectors")
    other = v.select(F.col("token").alias("t2"), "dim", F.col("value").alias("y"))
    met = v.join(other, "dim").filter((F.col("token") != F.col("t2")) & (F.col("token").substr(1, 1) == F.col("t2").substr(1, 1)))  # functions by functions: a vocabulary
    s = met.groupBy(F.col("token").alias("t1"), "t2").agg(F.round(F.sum(F.col("value") * F.col("y")), 9).alias("s"))
    materialize(s.withColumn("rk", F.row_number().over(Window.partitionBy("t1").orderBy(F.desc("s"), "t2"))), "sims").createOrReplaceTempView("sims")


def _spark_features(spark, corpus: bool) -> None:
    """Views cx (cf) and cl, over cand."""
    known = [C.QUALITY_DIM, K.REFERENCE_DIM, *progressions(_PAIRS)]
    for relation in ("pch", "pkeys"):
        _view(spark, relation, known)
    _profile_views(spark)
    steps = [C.KEY_PC_DIM, K.REFERENCE_DIM, *features(corpus)]
    late = ("cs AS", "cp AS", "cl AS")
    _view(spark, "cx", [x for x in steps if not x.startswith(late)])
    _view(spark, "cl", [x for x in steps if x.startswith(late)])
    spark.table("cx").createOrReplaceTempView("cf")


def _substitutes(spark, sf):
    asked = _Asked(spark, contexts=False)
    _view(spark, "cand", plain_candidates(24))
    real = spark.table("token_dim").select("token")
    s = asked.positions.select("req", "hist", F.element_at("hist", -1).alias("l"), F.col("actual").alias("o"), "r", (F.col("pos") % 2 == 0).alias("keep_function"), (F.col("pos") % 3 == 0).alias("smooth"), (F.col("pos") % 5 == 0).alias("surprising")).distinct()
    s = s.join(real.withColumnRenamed("token", "l"), "l", "left_semi").join(real.withColumnRenamed("token", "o"), "o", "left_semi").join(real.select(F.col("token").alias("r"), F.lit(1).alias("known")), "r", "left").filter("r IS NULL OR known = 1").drop("known")
    s = materialize(s.withColumn("sid", F.concat_ws("|", "req", "o", F.coalesce("r", F.lit("")), "keep_function", "smooth", "surprising")), "places")
    s.createOrReplaceTempView("sreq")
    null = F.lit(None).cast("string")
    after = s.filter("r IS NOT NULL").join(spark.table("cand").select("req", F.col("token").alias("cand")), "req").select("sid", "cand", F.slice(F.concat("hist", F.array("cand")), F.greatest(F.lit(1), F.size("hist") - 2), 4).alias("hist"), F.col("r").alias("token"), null.alias("genre"), null.alias("section"))
    after = materialize(after.withColumn("req", P.request_key("hist")), "asks-after")
    p = L.likelihoods(after.select("req", "hist", "genre", "section").distinct(), after, asked.model, keep=materialize)
    materialize(after.join(p, ["req", "token"]).select("sid", F.col("cand").alias("token"), "p"), "sright").createOrReplaceTempView("sright")
    singles = "SELECT token AS a, CAST(NULL AS STRING) AS b FROM cand UNION SELECT l, NULL FROM sreq UNION SELECT o, NULL FROM sreq UNION SELECT r, NULL FROM sreq WHERE r IS NOT NULL"
    for relation in ("pch", "pkeys"):
        _view(spark, relation, [C.QUALITY_DIM, K.REFERENCE_DIM, *progressions(singles)])
    _profile_views(spark, ("p_roman", "p_vroot"))
    _view(spark, "sall", substitutes()[2:3])
    _view(spark, "svoice", substitutes()[1:2])
    return spark.sql(T.query([substitutes()[0], *substitutes()[3:]], SELECTS["substitutes"]))


def _held(asked: _Asked):
    return asked.positions.groupBy("req", "actual").agg(F.count(F.lit(1)).alias("n"))


def _evaluated(spark, sf):
    asked = _Asked(spark)
    _view(spark, "cand", plain_candidates(30))
    _spark_features(spark, False)
    materialize(_held(asked), "held").createOrReplaceTempView("held")
    real = asked.positions.join(spark.table("hreq").select("req"), "req", "left_semi")
    materialize(P.sample_positions(real, BENCHMARKED, BENCH_SEED).select("req").distinct(), "bench").createOrReplaceTempView("bench")
    _view(spark, "squery", [_EVAL_DIM, *scored_queries()])
    materialize(E.greedy_diverse(spark.table("squery"), 30), "picked").createOrReplaceTempView("picked")
    return spark.sql(T.query(evaluation(), SELECTS["recommend_eval"]))


def fit_plausibility(spark, sf, cap: int = 14):
    """feature, weight, fitted to the positions of the dev split (even songs; shrinkage and epochs are chosen on odd ones), with the losses on the test split before and after."""
    spark = isolated(spark)
    _colored(spark, sf, False)
    made = {}
    for split in ("dev", "test"):
        asked = _Asked(spark, split)
        _view(spark, "base", [*plain_candidates(cap)[:-1], plain_candidates(cap)[-1].replace("cand AS", "base AS")])
        actual = asked.positions.select("req", F.col("actual").alias("token"), (F.substring_index("place", ":", 1).cast("long") % 2).alias("odd")).groupBy("req", "token", "odd").agg(F.count(F.lit(1)).alias("n"))
        materialize(actual, "actual").createOrReplaceTempView("actual")
        # the actual token is a candidate too, where it can be realised in the mode
        observed = "SELECT DISTINCT a.req, a.token FROM actual a JOIN hreq r ON r.req = a.req JOIN token_dim t ON t.token = a.token LEFT ANTI JOIN base b ON b.req = a.req AND b.token = a.token WHERE substr(a.token, 1, 1) = r.m"
        _view(spark, "cand", [f"cand AS (SELECT req, token, ngram_p, graph_p, similarity, place FROM base UNION ALL SELECT o.req, o.token, coalesce(n.p, 0e0), 0e0, CAST(NULL AS DOUBLE), 0 FROM ({observed}) o LEFT JOIN ngt n ON n.req = o.req AND n.token = o.token)"])
        _spark_features(spark, False)
        rows = spark.table("cx").alias("c").join(spark.table("actual").select("req", F.col("token").alias("actual"), "odd", "n"), "req").filter("place > 0 OR token = actual")
        rows = rows.withColumn("query", F.concat_ws("|", "req", "actual", "odd")).withColumn("is_actual", F.col("token") == F.col("actual"))
        made[split] = materialize(W.examples(rows, list(WEIGHTS), "odd"), f"examples-{split}")
    prior = [6.0 if f == "log_p_ngram" else 0.0 for f in WEIGHTS]
    weights, _ = W.fit(made["dev"].filter("odd = 0"), made["dev"].filter("odd = 1"), prior)
    before, after = W.step(made["test"], prior)[0], W.step(made["test"], weights)[0]
    return spark.createDataFrame([(f, round(w, 8), round(before, 8), round(after, 8)) for f, w in zip(WEIGHTS, weights, strict=True)], "feature string, weight double, test_loss_prior double, test_loss double")


def _spark(name: str):
    def run(spark, sf):
        spark = isolated(spark)
        _colored(spark, sf, False)
        if name == "substitutes":
            return _substitutes(spark, sf)
        if name == "recommend_eval":
            return _evaluated(spark, sf)
        if name != "candidate_sources":
            _measured(spark)
            _view(spark, "norms", K.color_norms(T.SPARK))
        _Asked(spark)
        _graph(spark)
        _view(spark, "cand", candidates())
        if name != "candidate_sources":
            _spark_features(spark, True)
        return spark.sql(T.query([_INTENT_DIM], SELECTS[name]))

    run.__name__ = name
    return run


QUERIES = {n: _spark(n) for n in SELECTS} | {"fit_plausibility": fit_plausibility}
ORACLE = {n: _duck(n) for n in SELECTS}
