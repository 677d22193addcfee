"""Queries: the whole property graph over chords and functions, and the corpus reports. SQL for Spark and DuckDB alike; in Spark, what several steps read is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chords as C
from ..operators import color as K
from ..operators import embed as E
from ..operators import graph as G
from ..operators import theory as T
from ..sources.fixtures import CHORD_SQL, isolated, materialize
from .color import _ABST, PATTERNS_SQL, _profile_steps, pattern_views
from .embeddings import W_SQL, rp_sql
from .harmony import _ctes, _relation, _staged, _view
from .sequences import MIN_CONTEXT, sql

#: Contextual transitions rarer than this aren't edges.
LEAST_EDGE = 5
#: Places of a function's vector.
FUNCTION_DIMS = 64
_W = "PARTITION BY song, ordinal ORDER BY pos"
# Upper-case and lower-case degrees that are at home in each mode.
_HOME = {"M": "('I', 'ii', 'iii', 'IV', 'V', 'vi', 'vii')", "m": "('i', 'ii', 'III', 'iv', 'v', 'VI', 'VII')"}


def transitions(d: T.Dialect) -> list[str]:
    """rtr: context, a, b, count, support, prob, pmi of the functions in roman."""
    keys = d.some(["'global'", "'genre:' || genre", "'section:' || section", "'decade:' || decade", "'genre_section:' || genre || ':' || section"])
    return [
        f"rpair AS (SELECT song, section, genre, decade, token AS a, lead(token) OVER ({_W}) AS b FROM roman)",
        f"rctx AS (SELECT song, a, b, {keys} AS context FROM rpair WHERE b IS NOT NULL)",
        "rcount AS (SELECT context, a, b, count(*) AS count, count(DISTINCT song) AS support FROM rctx GROUP BY context, a, b)",
        "rall AS (SELECT context, sum(count) AS n FROM rcount GROUP BY context)",
        "rout AS (SELECT context, a, sum(count) AS n FROM rcount GROUP BY context, a)",
        "rin AS (SELECT context, b, sum(count) AS n FROM rcount GROUP BY context, b)",
        f"""rtr AS (SELECT c.context, c.a, c.b, c.count, c.support, CAST(c.count AS DOUBLE) / o.n AS prob, ln(CAST(c.count AS DOUBLE) * t.n / (CAST(o.n AS DOUBLE) * i.n)) AS pmi
  FROM rcount c JOIN rall t ON t.context = c.context JOIN rout o ON o.context = c.context AND o.a = c.a JOIN rin i ON i.context = c.context AND i.b = c.b WHERE c.context = 'global' OR t.n >= {MIN_CONTEXT})""",
    ]


def edges() -> list[str]:
    """cedges: type, context, src, dst, count, prob, weight, positions (of a token in a pattern, from 0), of eight kinds, over rtr, roman, abst, vtop, rplaces and near."""
    head = lambda kind, a, b, context="'global'", count="CAST(NULL AS BIGINT)", prob="CAST(NULL AS DOUBLE)", weight="CAST(NULL AS DOUBLE)", positions="CAST(NULL AS STRING)": f"SELECT '{kind}' AS type, {context} AS context, {a} AS src, {b} AS dst, {count} AS count, {prob} AS prob, {weight} AS weight, {positions} AS positions"
    lead = "FROM vtop v JOIN vplay f ON f.canon = v.from_chord JOIN vplay t ON t.canon = v.to_chord JOIN vlead m ON " + K._same("m", "f", "t")
    kinds = [
        head("TRANSITIONS_TO", "'function:' || a", "'function:' || b", "context", "count", "prob", "pmi") + f" FROM rtr WHERE context = 'global' OR count >= {LEAST_EDGE}",
        head("FUNCTIONS_AS", "'chord:' || canon", "'function:' || token", count="count(*)") + " FROM roman GROUP BY canon, token",
        head("ABS_TRANSITIONS_TO", "'chord:' || from_chord", "'chord:' || to_chord", count="count") + " FROM abst",
        head("VOICE_LEADS_TO", "'chord:' || v.from_chord", "'chord:' || v.to_chord", weight="CAST(m.total AS DOUBLE)") + " " + lead,
        head("PATTERN_CONTAINS", "'pattern:' || pattern", "'function:' || token", count="places", positions="positions") + " FROM rplaces",
        head("HAS_ROOT", "'chord:' || canon", "'pitch_class:' || root") + " FROM cchord",
        head("HAS_QUALITY", "'chord:' || canon", "'chord_quality:' || quality") + " FROM cchord",
        head("SIMILAR_TO", "'function:' || query", "'function:' || id", weight="cosine") + " FROM near",
    ]
    return ["cchord AS (SELECT DISTINCT c.canon, d.root, c.quality FROM ch c JOIN chord_dim d ON d.symbol = c.symbol)", "cedges AS (" + "\n UNION ALL ".join(kinds) + ")"]


def nodes() -> list[str]:
    """cnodes: id, type, label, chromaticity (of functions, by their figure), of twelve kinds."""
    some = lambda kind, label, rest: f"SELECT '{kind}' AS type, {label} AS label {rest}"
    constants = C.values("fixed_nodes", "type, label", [*(("pitch_class", t) for t in C.TONICS), *(("interval", str(i)) for i in range(12)), *(("color_axis", a) for a in (*K.AXES, "surprise"))])
    kinds = [
        "SELECT type, label FROM fixed_nodes",
        some("key", "key_name", "FROM section_key"), some("genre", "genre", "FROM ch"), some("section", "section", "FROM ch"), some("era", "decade", "FROM ch"),
        some("relationship_type", "rule", "FROM facts"), some("chord", "canon", "FROM cchord"), some("pitch_class", "root", "FROM cchord"), some("chord_quality", "quality", "FROM cchord"),
        some("function", "token", "FROM roman"), some("pattern", "pattern", "FROM rplaces"),
    ]
    figure, degree = "substr(label, 3)", "regexp_extract(substr(label, 3), '^([ivIV]+)', 1)"
    rough = f"CASE WHEN type <> 'function' THEN NULL WHEN substr({figure}, 1, 1) IN ('b', '#') THEN 0.8e0 WHEN instr({figure}, '/') > 0 THEN 0.7e0 WHEN (substr(label, 1, 1) = 'M' AND {degree} IN {_HOME['M']}) OR (substr(label, 1, 1) = 'm' AND {degree} IN {_HOME['m']}) THEN 0.0e0 ELSE 0.5e0 END"
    return [constants, "nd AS (" + " UNION ".join(kinds) + ")", f"cnodes AS (SELECT type || ':' || label AS id, type, label, {rough} AS chromaticity FROM nd WHERE label IS NOT NULL AND label <> '')"]


#: DuckDB: near, the ten functions nearest to each in the transition graph; its steps are its own.
_NEAR_SQL = "near AS (" + sql(
    "ed AS (SELECT a AS src, b AS dst, count FROM rtr WHERE context = 'global')", W_SQL, rp_sql(FUNCTION_DIMS),
    "SELECT query, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS r FROM (SELECT x.token AS query, y.token AS id, round(sum(x.value * y.value), 9) AS cosine FROM rp x JOIN rp y ON x.dim = y.dim AND x.token <> y.token GROUP BY ALL) z) WHERE r <= 10",
) + ")"
_TOPF = "topf AS (SELECT id, n FROM (SELECT id, sum(count) AS n FROM (SELECT src AS id, count FROM cedges WHERE type = 'TRANSITIONS_TO' AND context = 'global' UNION ALL SELECT dst, count FROM cedges WHERE type = 'TRANSITIONS_TO' AND context = 'global') x GROUP BY id) y ORDER BY n DESC, id LIMIT 120)"
_FUNCTIONS = "ask AS (SELECT id FROM cnodes WHERE type = 'function')"
GRAPH = {
    "graph_nodes": ([], "SELECT id, type, label, chromaticity FROM cnodes"),
    "graph_edges": ([], "SELECT type, context, src, dst, count, round(prob, 9) AS prob, round(weight, 9) + 0e0 AS weight, positions FROM cedges"),
    "node_edge_census": ([], """SELECT kind, type, n, loose FROM (SELECT 'node' AS kind, type, count(*) AS n, CAST(0 AS BIGINT) AS loose FROM cnodes GROUP BY type
  UNION ALL SELECT 'edge', e.type, count(*), sum(CASE WHEN s.id IS NULL OR t.id IS NULL THEN 1 ELSE 0 END) FROM cedges e LEFT JOIN cnodes s ON s.id = e.src LEFT JOIN cnodes t ON t.id = e.dst GROUP BY e.type) x"""),
    # both directions of every function, every type and context
    "adjacent_edges": ([_FUNCTIONS], "SELECT 'out' AS direction, e.type, e.context, e.src, e.dst, e.count, round(e.prob, 9) AS prob FROM cedges e JOIN ask a ON a.id = e.src UNION ALL SELECT 'in', e.type, e.context, e.src, e.dst, e.count, round(e.prob, 9) FROM cedges e JOIN ask a ON a.id = e.dst"),
    "explain_edge": ([], """SELECT src, dst, count(*) AS edges, sum(count) AS count, max(CASE WHEN type = 'TRANSITIONS_TO' AND context = 'global' THEN 'transition:' || substr(src, 10) || '->' || substr(dst, 10) || ':global' END) AS fact_id, count(DISTINCT context) AS contexts
  FROM cedges GROUP BY src, dst"""),
}
COLORED = {
    "node_lookup": ([_TOPF], "SELECT n.id, n.type, n.label, n.chromaticity, s.support, round(c.brightness, 9) + 0e0 AS brightness, round(c.tension, 9) + 0e0 AS tension FROM cnodes n JOIN topf t ON t.id = n.id LEFT JOIN subj s ON s.subject_type = n.type AND s.subject_id = n.label LEFT JOIN p_color c ON c.song = s.subject_type || ' ' || s.subject_id"),
    "export_snapshot": ([_TOPF], """SELECT e.src, e.dst, e.count, round(c.chromaticity, 9) + 0e0 AS chromaticity FROM (SELECT src, dst, count FROM cedges WHERE type = 'TRANSITIONS_TO' AND context = 'global' AND src IN (SELECT id FROM topf) AND dst IN (SELECT id FROM topf) ORDER BY count DESC, src, dst LIMIT 1200) e
  LEFT JOIN p_color c ON c.song = 'function ' || substr(e.src, 10)"""),
}
# Bounds of the buckets of key confidence.
_BUCKETS = ((0.0, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 0.95), (0.95, 1.000000001))


def _report() -> list[str]:
    """report: metric, item, value."""
    bucket = " UNION ALL ".join(f"SELECT 'confidence' AS metric, '{lo}-{hi}' AS item, CAST(sum(CASE WHEN p >= {lo}e0 AND p < {hi}e0 THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM section_key" for lo, hi in _BUCKETS)
    one = lambda metric, expr, rel: f"SELECT '{metric}' AS metric, '' AS item, CAST({expr} AS DOUBLE) AS value FROM {rel}"
    return [
        f"bk AS ({T.best_keys('skeys')})",
        "firsts AS (SELECT song, min(ordinal) AS ordinal, count(DISTINCT key_name) AS keys FROM section_key GROUP BY song)",
        "amb AS (SELECT f.song, f.keys, CASE WHEN b.ambiguous THEN 1 ELSE 0 END AS ambiguous FROM firsts f JOIN bk b ON b.song = f.song AND b.ordinal = f.ordinal)",
        "toptok AS (SELECT token, n FROM (SELECT token, count(*) AS n FROM roman GROUP BY token) x ORDER BY n DESC, token LIMIT 50)",
        "smp AS (SELECT song, count(*) AS n FROM section_key WHERE song IN (SELECT song FROM (SELECT DISTINCT song FROM section_key) x ORDER BY md5('1:' || CAST(song AS STRING)) LIMIT 20) GROUP BY song)",
        "report AS (" + " UNION ALL ".join([
            one("songs", "count(*)", "firsts"), one("sections", "count(*)", "section_key"), one("tokens", "count(*)", "roman"), bucket,
            one("ambiguous_song_rate", "avg(CAST(ambiguous AS DOUBLE))", "amb"), one("modulation_song_rate", "avg(CASE WHEN keys > 1 THEN 1e0 ELSE 0e0 END)", "amb"),
            one("label_coverage_rate", "(SELECT count(*) FROM (SELECT DISTINCT song, ordinal FROM facts) y) / CAST(count(*) AS DOUBLE)", "section_key"),
            "SELECT 'top_token', token, CAST(n AS DOUBLE) FROM toptok", "SELECT 'sampled_song', CAST(song AS STRING), CAST(n AS DOUBLE) FROM smp",
        ]) + ")",
    ]


def _quality() -> list[str]:
    """quality: metric, item, value."""
    one = lambda metric, expr, rel: f"SELECT '{metric}' AS metric, '' AS item, CAST({expr} AS DOUBLE) AS value FROM {rel}"
    return [
        "told AS (SELECT l.song, l.ordinal, l.symbol, d.ok, d.dangling FROM lines l JOIN chord_dim d ON d.symbol = l.symbol)",
        "whole AS (SELECT song, ordinal, min(CASE WHEN ok THEN 1 ELSE 0 END) AS ok FROM told GROUP BY song, ordinal)",
        f"gpair AS (SELECT genre, token AS a, lead(token) OVER ({_W}) AS b FROM roman)",
        "gcount AS (SELECT genre, a, b, count(*) AS n FROM gpair WHERE b IS NOT NULL GROUP BY genre, a, b)",
        "acount AS (SELECT a, b, sum(n) AS n FROM gcount GROUP BY a, b)",
        "labelled AS (SELECT DISTINCT song, ordinal, from_index FROM facts)",
        "quality AS (" + " UNION ALL ".join([
            one("chord_parse_rate", "avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END)", "told"), one("progression_parse_rate", "avg(CAST(ok AS DOUBLE))", "whole"), one("progressions", "count(*)", "whole"),
            one("confidence_min", "min(p)", "section_key"), one("confidence_max", "max(p)", "section_key"), one("confidence_mean", "avg(p)", "section_key"), one("transitions", "sum(n)", "acount"),
            one("label_coverage", "(SELECT count(*) FROM labelled) / CAST(sum(n) AS DOUBLE)", "acount"), one("dangling_bass", "sum(CASE WHEN dangling THEN 1 ELSE 0 END)", "told"), one("unparsed", "sum(CASE WHEN ok THEN 0 ELSE 1 END)", "told"),
            "SELECT 'global_transition', a || ' ' || b, CAST(n AS DOUBLE) FROM (SELECT a, b, n FROM acount ORDER BY n DESC, a, b LIMIT 100) x",
            "SELECT 'genre_transition', genre || ' ' || a || ' ' || b, CAST(n AS DOUBLE) FROM (SELECT genre, a, b, n FROM gcount WHERE genre IS NOT NULL ORDER BY n DESC, a, b, genre LIMIT 100) y",
        ]) + ")",
    ]


REPORTS = {
    "corpus_report": ("facts", _report(), "SELECT metric, item, round(value, 9) AS value FROM report"),
    "quality_metrics": ("facts", _quality(), "SELECT metric, item, round(value, 9) AS value FROM quality"),
    # the most frequent symbols that can't be parsed, with the parse rate
    "vocab_report": ("dim", ["told AS (SELECT l.symbol, d.ok FROM lines l JOIN chord_dim d ON d.symbol = l.symbol)", "rate AS (SELECT count(*) AS symbols, avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END) AS parse_rate FROM told)", "bad AS (SELECT symbol, count(*) AS n FROM told WHERE NOT ok GROUP BY symbol)"],
        "SELECT b.symbol, b.n, r.symbols, round(r.parse_rate, 9) AS parse_rate FROM (SELECT symbol, n FROM bad ORDER BY n DESC, symbol LIMIT 25) b CROSS JOIN rate r"),
}


def _duck(name: str) -> str:
    d = T.DUCK
    if name in REPORTS:
        depth, ctes, select = REPORTS[name]
        return T.query([CHORD_SQL, *_ctes(d, depth), *[x.replace("STRING", "VARCHAR") for x in ctes]], select)
    more, select = GRAPH.get(name) or COLORED[name]
    places = "rplaces AS (SELECT pattern, token, count(*) AS places, string_agg(pos, ',' ORDER BY pos) AS positions FROM rspots GROUP BY pattern, token)"
    ctes = [*_ctes(d, "facts"), C.KEY_PC_DIM, K.QUALITY_EXT, *K.voicings(), *_ABST, *K.leading_targets()[:-1]]
    both = ["vall2 AS (SELECT * FROM vpairs UNION SELECT " + K._pair("f", "t") + " FROM vtop v JOIN vplay f ON f.canon = v.from_chord JOIN vplay t ON t.canon = v.to_chord)"]
    ctes += [*K.successive(), *both, *K.motions("vall2"), *PATTERNS_SQL, places, *transitions(d), _NEAR_SQL, *edges(), *nodes()]
    if name in COLORED:
        ctes += [*K.color_axes(), *K.realized("roman"), *K.subjects(), *_profile_steps()]
    return T.query([CHORD_SQL, *[x.replace("STRING", "VARCHAR") for x in ctes], *more], select)


def transition_views(spark) -> None:
    """View rtr over the view roman, without support. Pairs are counted before contexts multiply them."""
    steps, some = transitions(T.SPARK), "section, genre, decade, a, b"
    counted = f"rsum AS (SELECT {some}, count(*) AS n FROM rpair WHERE b IS NOT NULL GROUP BY {some})"
    rctx = steps[1].replace("SELECT song, a, b,", "SELECT a, b, n,").replace("FROM rpair WHERE b IS NOT NULL", "FROM rsum")
    _view(spark, "rcount", [steps[0], counted, rctx, "rcount AS (SELECT context, a, b, sum(n) AS count FROM rctx GROUP BY context, a, b)"])
    _view(spark, "rtr", [*steps[3:-1], steps[-1].replace("c.support, ", "")])


#: Spark: both directions in one pass over the edges.
_ADJACENT = """SELECT direction, type, context, src, dst, count, round(prob, 9) AS prob FROM (SELECT e.*, explode(array_compact(array(CASE WHEN s.id IS NOT NULL THEN 'out' END, CASE WHEN t.id IS NOT NULL THEN 'in' END))) AS direction
  FROM cedges e LEFT JOIN ask s ON s.id = e.src LEFT JOIN ask t ON t.id = e.dst) x"""


def _graph_views(spark, sf, name: str) -> None:
    """Views cnodes and cedges as far as a query reads them; the queries with color read functions and their transitions alone, and also subj and p_color."""
    if name in COLORED:
        from .color import _profiled

        _profiled(spark, sf)
        transition_views(spark)
        _relation(spark, "cedges", ["cedges AS (" + edges()[1].removeprefix("cedges AS (").split("\n UNION ALL ")[0] + ")"])
        _relation(spark, "cnodes", ["nd AS (SELECT DISTINCT 'function' AS type, token AS label FROM roman)", nodes()[-1]])
        return
    rules = _staged(spark, sf, "facts", stored=True)
    _relation(spark, "facts", rules)
    pattern_views(spark)
    _relation(spark, "rplaces", ["rplaces AS (SELECT pattern, token, count(*) AS places, array_join(transform(array_sort(collect_list(pos)), x -> CAST(x AS STRING)), ',') AS positions FROM rspots GROUP BY pattern, token)"])
    _view(spark, "cchord", edges()[:1])
    if name != "graph_nodes":
        _view(spark, "vroot", [C.QUALITY_DIM, C.TONE_DIM, *K.voicings()])
        _view(spark, "vopt", [C.QUALITY_DIM, C.TONE_DIM, *K.voicings()])
        for step in (_ABST, K.leading_targets()[:2], K.leading_targets()[2:4], K.leading_targets()[4:], K.motions()):
            _view(spark, step[-1].split(" ", 1)[0], step)
        transition_views(spark)
        v = materialize(E.fastrp(spark.sql("SELECT a AS src, b AS dst, count FROM rtr WHERE context = 'global'"), FUNCTION_DIMS), "function-values")
        v = materialize(v.groupBy(F.col("token").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).getField("value").alias("vec")).withColumn("model", F.lit(0)), "function-vectors")
        # as many rows as the vocabulary has functions
        materialize(G.cosine_topk(v, v, 10).select("query", "id", "cosine"), "near").createOrReplaceTempView("near")
        _relation(spark, "cedges", edges()[1:])
    # patterns are distinct in rpats
    _relation(spark, "cnodes", [x.replace("FROM rplaces", "FROM rpats") for x in nodes()])
    if name == "adjacent_edges":
        _view(spark, "ask", [_FUNCTIONS])


def _spark(name: str):
    def run(spark, sf):
        spark = isolated(spark)
        if name in REPORTS:
            depth, ctes, select = REPORTS[name]
            rules = _staged(spark, sf, depth, stored=True, best=name == "corpus_report")
            if depth == "facts":
                _relation(spark, "facts", rules)
            return spark.sql(T.query(ctes, select))
        more, select = GRAPH.get(name) or COLORED[name]
        _graph_views(spark, sf, name)
        if name == "adjacent_edges":
            return spark.sql(_ADJACENT)
        return spark.sql(T.query(more, select) if more else select)

    run.__name__ = name
    return run


NAMES = (*GRAPH, *COLORED, *REPORTS)
QUERIES = {n: _spark(n) for n in NAMES}
ORACLE = {n: _duck(n) for n in NAMES}
