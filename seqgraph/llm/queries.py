"""The corpus operators as queries over the given tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .conversation_repair import repair_conversations
from .decontaminate import decontaminate
from .hard_negatives import hard_negatives
from .line_dedup import dedup_lines
from .lm_score import score_documents
from .mixing import mix
from .nbsvm import score, train
from .prefix_hash import as_text, fingerprint_documents
from .quality_rules import judged
from .secrets import joined, scan_secrets
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_files import token_digest


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count(3).alias("n_markov"))


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(load(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), cut=False).drop("clean_text", "item_ids")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).drop("copies", "body")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(load(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score(docs, train(docs, load(spark, sf_dir, "labels")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(load(spark, sf_dir, "documents"))
    return found.withColumns({c: as_text(c) for c in ("fingerprint", "edited_fingerprint")})


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(load(spark, sf_dir, "conversations")).drop("n_repaired")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_lm_score": op3_lm_score,
    "op4_decontaminate": op4_decontaminate,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_files": op7_token_files,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_fingerprints": op11_fingerprints,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item, w, least(13, len(w)) AS k FROM (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM b) ON len(w) >= k)),
m AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, g)),
hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
met AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(met.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN met USING (r)""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(t, chr(10)) IF trim(x, {_BLANK}) <> ''] AS ls FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(t) - length(translate(t, 'abcdefghijklmnopqrstuvwxyz', '')) AS n_lower FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR (n_upper > n_lower AND n_upper > 20) AS soft FROM m),
h AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft) AS DOUBLE) AS bad FROM f GROUP BY source),
p AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) - sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) * avg(1 / n) AS spread, sum(n) / count(*) AS size FROM h),
q AS (SELECT *, CASE WHEN spread > 1e-9 THEN greatest(1, mean * (1 - mean) / spread - 1) ELSE greatest(1, size) END AS weight FROM p),
v AS (SELECT source, mean, greatest(0.5, mean + sqrt(mean * (1 - mean) / (weight + 1))) AS bar, (bad + mean * weight) / (n + weight) AS rate, 2 * sqrt((bad + mean * weight) / (n + weight) * (1 - (bad + mean * weight) / (n + weight)) / (n + weight + 1)) AS off FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate - off > bar) AND NOT (soft AND NOT (rate + off < mean)) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
    "op12_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT [list_reduce([CAST(x AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) FOR x IN range(256)] AS tab),
src AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (SELECT src.*, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]))) % 20 AS fate FROM src, crc),
hurt AS (SELECT r, conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE fate <> 0),
told AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, r, copy) > 1 AS again, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, lag(role[1]) OVER w || role[1] AS pair
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, r, copy)),
seen AS (SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, body <> '' AND right(body, 1) NOT IN ('.', '!', '?') AS late FROM told),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM seen GROUP BY conv_id),
-- z: nothing yet, s, u, a: the cheapest edits so far to each state, as cost, audit and repaired rows
paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {'c': CAST(0 AS BIGINT), 'e': '', 'o': ''} AS z, {'c': CAST(1000000000 AS BIGINT), 'e': '', 'o': ''} AS s, {'c': CAST(2 AS BIGINT), 'e': 'I', 'o': chr(10) || 'user:'} AS u, {'c': CAST(4 AS BIGINT), 'e': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM stats
  UNION ALL
  SELECT conv_id, pos, z, s, least(u, {'c': a.c + 2, 'e': a.e || 'I', 'o': a.o || chr(10) || 'user:'}), a FROM (
  SELECT conv_id, pos, z, s, u, least(a, {'c': u.c + 2, 'e': u.e || 'I', 'o': u.o || chr(10) || 'assistant:'}) AS a FROM (
  SELECT conv_id, pos, z, s, least(u, {'c': z.c + 2, 'e': z.e || 'I', 'o': z.o || chr(10) || 'user:'}, {'c': s.c + 2, 'e': s.e || 'I', 'o': s.o || chr(10) || 'user:'}) AS u, a FROM (
  SELECT p.conv_id, t.pos, {'c': z.c + 3, 'e': z.e || 'D', 'o': z.o} AS z,
    least({'c': s.c + 3, 'e': s.e || 'D', 'o': s.o}, {'c': z.c + x.ks, 'e': z.e || 'K', 'o': z.o || x.kept}) AS s,
    least({'c': u.c + 3, 'e': u.e || 'D', 'o': u.o}, {'c': z.c + x.ku, 'e': z.e || 'K', 'o': z.o || x.kept}, {'c': s.c + x.ku, 'e': s.e || 'K', 'o': s.o || x.kept}, {'c': a.c + x.ku, 'e': a.e || 'K', 'o': a.o || x.kept},
      {'c': z.c + x.rr, 'e': z.e || 'R', 'o': z.o || x.ruser}, {'c': s.c + x.rr, 'e': s.e || 'R', 'o': s.o || x.ruser}, {'c': a.c + x.rr, 'e': a.e || 'R', 'o': a.o || x.ruser}) AS u,
    least({'c': a.c + 3, 'e': a.e || 'D', 'o': a.o}, {'c': u.c + x.ka, 'e': u.e || 'K', 'o': u.o || x.kept}, {'c': u.c + x.rr, 'e': u.e || 'R', 'o': u.o || x.rasst}) AS a
  FROM paths p JOIN (SELECT conv_id, pos, {'kept': chr(10) || role || ':' || text, 'ruser': chr(10) || 'user:' || text, 'rasst': chr(10) || 'assistant:' || text,
      'ks': CASE WHEN blank OR duplicate OR role[1] <> 's' THEN 1000000000 WHEN late THEN 1 ELSE 0 END, 'ku': CASE WHEN blank OR duplicate OR role[1] <> 'u' THEN 1000000000 WHEN late THEN 1 ELSE 0 END,
      'ka': CASE WHEN blank OR duplicate OR role[1] <> 'a' THEN 1000000000 WHEN late THEN 1 ELSE 0 END, 'rr': CASE WHEN blank OR duplicate THEN 1000000000 WHEN late THEN 3 ELSE 2 END} AS x FROM seen) t
    ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.pos + 1)))),
best AS (SELECT stats.*, least(z, a) AS b FROM paths JOIN stats ON paths.conv_id IS NOT DISTINCT FROM stats.conv_id AND pos = n)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(b.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN best ON i.conv_id IS NOT DISTINCT FROM best.conv_id""",
    "op13_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.x, b.x)]) AS BIGINT) AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT ar, a, b, s, row_number() OVER (PARTITION BY ar ORDER BY s DESC, b NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.ar, p.a, p.b, p.s, s.b AS neg, s.s AS ns, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.s DESC, s.b NULLS LAST) AS rank FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s QUALIFY rank <= 5)
SELECT a AS anchor_id, b AS positive_id, CAST(rank AS INTEGER) AS rank, neg AS negative_id, s AS positive_score, ns AS negative_score FROM n""",
    "op6_line_dedup": r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM rows),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
told AS (SELECT keyed.*, common.k IS NOT NULL AND top IS DISTINCT FROM doc_id AS dropped FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM told GROUP BY r, doc_id""",
}
