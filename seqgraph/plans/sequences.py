"""Queries over event sequences: contexts, transitions, n-grams, patterns, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sequence as S
from ..sources.fixtures import CONTEXT_SQL, EVENT_SQL, event_positions, event_sections, materialize

MIN_CONTEXT, MIN_SUPPORT = 300, 40
PRUNE = {3: 5, 4: 8, 5: 10}


def context_explode(spark, sf):
    rows = event_positions(spark, sf).select("song", "ordinal", "genre", "section", "decade").distinct()
    return S.explode_contexts(rows).select("song", "ordinal", "context")


def context_filter(spark, sf):
    return S.kept_contexts(event_positions(spark, sf), MIN_CONTEXT)


def transitions(spark, sf):
    return S.transitions(event_positions(spark, sf), MIN_CONTEXT)


def v1_transitions(spark, sf):
    return S.grouped_transitions(event_positions(spark, sf))


def ngram_table(spark, sf):
    p = event_positions(spark, sf)
    return S.ngram_counts(p, S.kept_contexts(p, MIN_CONTEXT), PRUNE)


def ngrams(spark, sf):
    return ngram_table(spark, sf)


def discount_stats(spark, sf):
    return S.discount_stats(ngram_table(spark, sf))


def found_patterns(spark, sf):
    """Frequent patterns and their lifts; what both read is stored once."""
    return S.patterns(materialize(event_sections(spark, sf), "sections"), MIN_SUPPORT, MIN_CONTEXT, keep=materialize)


def patterns(spark, sf):
    return found_patterns(spark, sf)[0]


def pattern_lifts(spark, sf):
    return found_patterns(spark, sf)[1]


def popular_patterns(spark, sf):
    found = found_patterns(spark, sf)[0]
    return found.select("pattern", "support").orderBy(F.desc("support"), "pattern").limit(500)


KEPT_SQL = f"""
kept AS (SELECT context, sum(n) AS bigrams FROM (SELECT context, greatest(count(*) - 1, 0) AS n FROM ctx GROUP BY context, song, ordinal) GROUP BY context
  HAVING context = 'global' OR sum(n) >= {MIN_CONTEXT})"""
PAIR_SQL = """
pairs AS (SELECT * FROM (SELECT context, song, token AS from_token, lead(token) OVER (PARTITION BY context, song, ordinal ORDER BY pos) AS to_token FROM ctx) WHERE to_token IS NOT NULL)"""
TRANSITION_SQL = f"""
trans AS (SELECT context, from_token, to_token, count, count / out AS prob, ln(count * total / (out * inc)) AS pmi, support FROM (
  SELECT *, CAST(sum(count) OVER (PARTITION BY context) AS DOUBLE) AS total, CAST(sum(count) OVER (PARTITION BY context, from_token) AS DOUBLE) AS out,
    CAST(sum(count) OVER (PARTITION BY context, to_token) AS DOUBLE) AS inc
  FROM (SELECT context, from_token, to_token, count(*) AS count, count(DISTINCT song) AS support FROM pairs GROUP BY ALL)) WHERE context = 'global' OR total >= {MIN_CONTEXT})"""
NGRAM_SQL = f"""
hist AS (SELECT context, song, ordinal, pos, token, list(token) OVER (PARTITION BY context, song, ordinal ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS back FROM ctx WHERE context IN (SELECT context FROM kept)),
grams AS (SELECT context, o.k AS ord, coalesce(array_to_string(back[len(back) - o.k + 2:], ' '), '') AS history, token, count(*) AS cnt FROM hist, (SELECT unnest([1, 2, 3, 4, 5]) AS k) o
  WHERE pos >= o.k - 1 AND (context = 'global' OR o.k <= 3) GROUP BY ALL),
conts AS (SELECT context, ord - 1 AS ord, CASE WHEN contains(history, ' ') THEN substr(history, instr(history, ' ') + 1) ELSE '' END AS history, token, count(*) AS cont FROM grams WHERE ord > 1 GROUP BY ALL),
ngrams AS (SELECT * FROM (SELECT context, ord AS "order", history, token, cnt, coalesce(cont, 0) AS cont, CAST(sum(cnt) OVER w AS BIGINT) AS total, count(*) OVER w AS distinct_next
  FROM grams LEFT JOIN conts USING (context, ord, history, token) WINDOW w AS (PARTITION BY context, ord, history))
  WHERE total >= CASE "order" WHEN 3 THEN {PRUNE[3]} WHEN 4 THEN {PRUNE[4]} WHEN 5 THEN {PRUNE[5]} ELSE 0 END)"""
def pattern_sql(support: int) -> str:
    return f"""
secs AS (SELECT song, genre, section, decade, ordinal, list(token ORDER BY pos) AS toks FROM seq GROUP BY ALL),
wins AS (SELECT song, ordinal, genre, section, decade, n AS length, toks[i:i + n - 1] AS w FROM (SELECT *, unnest(range(1, len(toks) - n + 2)) AS i FROM secs, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS n))),
turned AS (SELECT *, list_sort([{{'r': list_concat(w[k + 1:], w[1:k]), 'k': k}} FOR k IN range(0, length)])[1] AS best FROM wins),
win AS (SELECT song, genre, section, decade, length, array_to_string(best.r, ' ') AS pattern, best.k AS k FROM turned),
pats AS (SELECT pattern, length, count(*) AS support, least(count(DISTINCT song), 2000) AS song_count, array_to_string(list_sort(list(DISTINCT k)), ',') AS rotations FROM win GROUP BY pattern, length HAVING count(*) >= {support}),
wctx AS (SELECT *, unnest([x FOR x IN ['global', 'genre:' || genre, 'section:' || section, 'decade:' || decade, 'genre_section:' || genre || ':' || section] IF x IS NOT NULL]) AS context FROM win),
wtot AS (SELECT context, count(*) AS windows FROM wctx WHERE context IN (SELECT context FROM kept) GROUP BY context),
lifts AS (SELECT p.pattern, t.context, (coalesce(c.n, 0) / t.windows) / (p.support / (SELECT windows FROM wtot WHERE context = 'global')) AS lift
  FROM pats p CROSS JOIN wtot t LEFT JOIN (SELECT context, pattern, count(*) AS n FROM wctx GROUP BY ALL) c USING (pattern, context) WHERE t.context <> 'global' AND t.windows >= {MIN_CONTEXT})"""


PATTERN_SQL = pattern_sql(MIN_SUPPORT)


def sql(*parts: str) -> str:
    """A query: all but the last part are common table expressions."""
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts[:-1]) + " " + parts[-1]


BASE = (EVENT_SQL, CONTEXT_SQL)
QUERIES = {f.__name__: f for f in (context_explode, context_filter, transitions, v1_transitions, ngrams, discount_stats, patterns, pattern_lifts, popular_patterns)}
ORACLE = {
    "context_explode": sql(*BASE, "SELECT DISTINCT song, ordinal, context FROM ctx"),
    "context_filter": sql(*BASE, KEPT_SQL, "SELECT context, CAST(bigrams AS BIGINT) AS bigrams FROM kept"),
    "transitions": sql(*BASE, PAIR_SQL, TRANSITION_SQL, "SELECT * FROM trans"),
    "v1_transitions": sql(
        EVENT_SQL,
        "p AS (SELECT * FROM (SELECT genre, section, decade, token AS from_token, lead(token) OVER (PARTITION BY song, ordinal ORDER BY pos) AS to_token FROM seq) WHERE to_token IS NOT NULL)",
        """g AS (SELECT from_token, to_token, NULL AS genre, NULL AS section, NULL AS decade, count(*) AS count, 1 AS b FROM p GROUP BY 1, 2
  UNION ALL SELECT from_token, to_token, genre, NULL, NULL, count(*), 2 FROM p WHERE genre IS NOT NULL GROUP BY 1, 2, 3
  UNION ALL SELECT from_token, to_token, NULL, section, NULL, count(*), 3 FROM p WHERE section IS NOT NULL GROUP BY 1, 2, 4
  UNION ALL SELECT from_token, to_token, NULL, NULL, decade, count(*), 4 FROM p WHERE decade IS NOT NULL GROUP BY 1, 2, 5
  UNION ALL SELECT from_token, to_token, genre, section, NULL, count(*), 5 FROM p WHERE genre IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2, 3, 4)""",
        "SELECT from_token, to_token, genre, section, decade, count, count / sum(count) OVER (PARTITION BY b, from_token, genre, section, decade) AS probability FROM g",
    ),
    "ngrams": sql(*BASE, KEPT_SQL, NGRAM_SQL, "SELECT * FROM ngrams"),
    "discount_stats": sql(*BASE, KEPT_SQL, NGRAM_SQL, 'SELECT context, "order", count(*) FILTER (WHERE cnt = 1) AS n1, count(*) FILTER (WHERE cnt = 2) AS n2 FROM ngrams GROUP BY ALL'),
    "patterns": sql(*BASE, KEPT_SQL, PATTERN_SQL, "SELECT * FROM pats"),
    "pattern_lifts": sql(*BASE, KEPT_SQL, PATTERN_SQL, "SELECT * FROM lifts"),
    "popular_patterns": sql(*BASE, KEPT_SQL, PATTERN_SQL, "SELECT pattern, support FROM pats ORDER BY support DESC, pattern LIMIT 500"),
}
