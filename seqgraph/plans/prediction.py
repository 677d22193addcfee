"""Queries: next-token prediction for every held-out position, and its evaluation. The model is fitted to the train split; positions that ask the same are one request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import predict as P
from ..operators import sequence as S
from ..sources.fixtures import CONTEXT_SQL, EVENT_SQL, event_positions, materialize
from .sequences import KEPT_SQL, MIN_CONTEXT, NGRAM_SQL, PRUNE, sql

#: Positions that sample_positions shows, and its seed.
N, SEED = 120, 7
KS = (10.0, 25.0, 50.0, 100.0, 200.0, 400.0, 800.0)


def _split(spark, sf):
    return event_positions(spark, sf).withColumn("split", P.assign_split(F.col("song")))


def _held(spark, sf):
    return P.held_positions(_split(spark, sf).filter("split <> 'train'"))


class Model:
    """The n-gram model of the train split, the held-out positions, their distinct requests, and the evidence for these."""

    def __init__(self, spark, sf):
        train = materialize(_split(spark, sf).filter("split = 'train'"), "train")
        self.contexts = materialize(S.kept_contexts(train, MIN_CONTEXT), "contexts")
        self.ngrams = materialize(S.ngram_counts(train, self.contexts, PRUNE), "ngrams")
        self.stats = S.discount_stats(self.ngrams)
        self.positions = materialize(_held(spark, sf), "positions")
        self.requests = self.positions.select("req", "hist", "genre", "section").distinct()

    @property
    def chain(self):
        return P.context_chain(self.requests, self.contexts)

    @property
    def rows(self):
        return materialize(P.evidence(self.chain, self.ngrams, self.stats), "evidence")

    def metrics(self, variants, rows=None):
        rows = self.rows if rows is None else rows
        return P.position_metrics(P.distributions(rows, variants), self.positions, [v.name for v in variants])


def assign_split(spark, sf):
    return _split(spark, sf).select("song", "split").distinct()


def split_filter(spark, sf):
    return _split(spark, sf).filter("split = 'train'").select("song", "ordinal", "pos", "token")


def leak_check(spark, sf):
    """Songs of the held-out positions, by what their places say, and how many of them the model was fitted to."""
    m = Model(spark, sf)
    train = _split(spark, sf).filter("split = 'train'").select(F.col("song").cast("string").alias("song"), F.lit(1).alias("fitted")).distinct()
    held = m.positions.select(F.substring_index("place", ":", 1).alias("song")).distinct()
    return held.join(train, "song", "left").agg(F.count(F.lit(1)).alias("held"), F.count("fitted").alias("leaked"))


def sample_positions(spark, sf):
    held = P.sample_positions(_held(spark, sf), N, SEED)
    return held.select("place", F.array_join("hist", " ").alias("hist"), "genre", "section", "actual", "bucket")


def context_chain(spark, sf):
    return Model(spark, sf).chain.select("req", "level", "context")


def kn_context_distribution(spark, sf):
    return P.contributions(Model(spark, sf).rows).groupBy("req", "context", "token").agg(F.sum("amount").alias("p"))


def context_mixing(spark, sf):
    return P.mixed(Model(spark, sf).rows)


def renormalize(spark, sf):
    return P.renormalized(P.contributions(Model(spark, sf).rows).filter("order > 1 AND context = 'global'").groupBy("req", "token").agg(F.sum("amount").alias("p")))


def context_lift(spark, sf):
    return P.distribution(Model(spark, sf).rows)


def distribution_batch(spark, sf):
    return P.distribution(Model(spark, sf).rows, lift=False)


def max_order_cap(spark, sf):
    return P.distribution(Model(spark, sf).rows, cap=2)


def predict_topn(spark, sf):
    rows = Model(spark, sf).rows
    return P.top_n(P.distribution(rows), rows, 3)


def predict_breakdown(spark, sf):
    rows = Model(spark, sf).rows
    return P.breakdown(P.distribution(rows), rows, 3)


def hard_backoff(spark, sf):
    return P.hard_backoff(Model(spark, sf).rows)


def unigram_baseline(spark, sf):
    return P.unigram(Model(spark, sf).ngrams)


def position_metrics(spark, sf):
    return Model(spark, sf).metrics([P.Variant("lift")]).drop("model")


def aggregate_metrics(spark, sf):
    return P.aggregated(position_metrics(spark, sf))


def ece(spark, sf):
    return P.ece(position_metrics(spark, sf))


def slice_metrics(spark, sf):
    m = Model(spark, sf)
    met = materialize(m.metrics([P.Variant("lift")]), "metrics")
    return reduce(lambda a, b: a.unionByName(b), [P.slices(met, m.positions, d, 2) for d in ("genre", "section", "bucket")])


def model_comparison(spark, sf):
    """The ten models: unigram, hard backoff, and orders 2 to 5 with and without contexts."""
    m = Model(spark, sf)
    rows = m.rows
    variants = [P.Variant(f"kn{o}{'_context' * c}", o, contexts=bool(c)) for o in range(2, 6) for c in (0, 1)]
    hard = P.position_metrics(P.hard_backoff(rows).withColumn("model", F.lit("hard_backoff")), m.positions, ["hard_backoff"])
    return P.aggregated(m.metrics(variants, rows).unionByName(hard).unionByName(P.unigram_metrics(P.unigram(m.ngrams), m.positions)), "model")


def policy_comparison(spark, sf):
    m = Model(spark, sf)
    rows = m.rows
    variants = [P.Variant("lift"), P.Variant("interpolation", lift=False), P.Variant("global", contexts=False)]
    v1 = P.position_metrics(P.hard_backoff(rows).withColumn("model", F.lit("v1")), m.positions, ["v1"])
    return P.aggregated(m.metrics(variants, rows).unionByName(v1), "model")


def tune_mixing_k(spark, sf):
    found = P.aggregated(Model(spark, sf).metrics([P.Variant(str(k), k=k, lift=False) for k in KS]), "model")
    return found.select(F.col("model").cast("double").alias("k"), F.round("mrr", 9).alias("mrr")).orderBy(F.desc("mrr"), "k").limit(1)


# ---- DuckDB --------------------------------------------------------------------------------------------------------

SPLIT_SQL = """
dig AS (SELECT song, [instr('0123456789abcdef', c) - 1 FOR c IN string_split(sha256(CAST(song AS VARCHAR)), '')] AS d FROM (SELECT DISTINCT song FROM seq0)),
spl AS (SELECT song, CASE (5 * (d[64] % 4) + 16 * (list_sum(d) % 5)) % 20 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split FROM dig)"""
EVENTS0 = EVENT_SQL.replace("seq AS (", "seq0 AS (")
TRAIN_SQL = "seq AS (SELECT * FROM seq0 JOIN spl USING (song) WHERE split = 'train')"
REQ_SQL = """
held AS (SELECT song || ':' || ordinal || ':' || pos AS place, array_to_string(hist, ' ') || '|' || coalesce(genre, '') || '|' || coalesce(section, '') AS req, hist, genre, section, actual, bucket FROM (
  SELECT song, ordinal, pos, list(token) OVER (PARTITION BY song, ordinal ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hist,
  genre, section, token AS actual, least(pos, 4) AS bucket FROM seq0 JOIN spl USING (song) WHERE split <> 'train') WHERE pos >= 1),
reqs AS (SELECT DISTINCT req, hist, genre, section FROM held)"""
STATS_SQL = """
stats AS (SELECT context, "order", CASE WHEN n1 + 2 * n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0 END AS d FROM (
  SELECT context, "order", count(*) FILTER (WHERE cnt = 1) AS n1, count(*) FILTER (WHERE cnt = 2) AS n2 FROM ngrams GROUP BY ALL))"""
CHAIN_SQL = """
chain AS (SELECT req, hist, level, context FROM (SELECT req, hist, 0 AS level, 'genre_section:' || genre || ':' || section AS context FROM reqs
  UNION ALL SELECT req, hist, 1, 'genre:' || genre FROM reqs UNION ALL SELECT req, hist, 2, 'section:' || section FROM reqs UNION ALL SELECT req, hist, 3, 'global' FROM reqs)
  WHERE context IN (SELECT context FROM kept))"""
BASE = (EVENTS0, SPLIT_SQL, TRAIN_SQL, CONTEXT_SQL, KEPT_SQL, NGRAM_SQL, REQ_SQL, STATS_SQL, CHAIN_SQL)


def parts_sql(name: str, chain: str = "chain", cap: int = 5, other: int = 3) -> str:
    """Contributions by order; the running product over longer orders is a window here."""
    return f"""
{name}_st AS (SELECT *, CASE WHEN k = 1 THEN '' ELSE array_to_string(hist[len(hist) - k + 2:], ' ') END AS history FROM (
  SELECT req, hist, level, context, top, unnest(range(1, top + 1)) AS k FROM (SELECT *, least(len(hist), least(CASE context WHEN 'global' THEN {cap} ELSE {min(cap, other)} END, 5) - 1) + 1 AS top FROM {chain}))),
{name}_kn AS (SELECT DISTINCT s.req, s.level, s.k, s.top, total, d * distinct_next / total AS lam FROM {name}_st s JOIN ngrams n ON n.context = s.context AND n."order" = s.k AND n.history = s.history JOIN stats t ON t.context = s.context AND t."order" = s.k),
{name}_w AS (SELECT req, level, k, coalesce(product(lam) OVER (PARTITION BY req, level ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS w,
  max(CASE WHEN k = top THEN total ELSE 0 END) OVER (PARTITION BY req, level) AS n FROM {name}_kn),
{name} AS (SELECT s.req, s.level, s.context, s.k, s.history, n.token, n.cnt, w.n, w.w * CASE WHEN s.k = 1 THEN CASE WHEN sum(cont) OVER (PARTITION BY s.req, s.level, s.k) > 0 THEN cont / sum(cont) OVER (PARTITION BY s.req, s.level, s.k) END
    ELSE greatest(cnt - d, 0) / total END AS amount, cont
  FROM {name}_st s JOIN ngrams n ON n.context = s.context AND n."order" = s.k AND n.history = s.history JOIN stats t ON t.context = s.context AND t."order" = s.k JOIN {name}_w w ON w.req = s.req AND w.level = s.level AND w.k = s.k)"""


def mixed_sql(name: str, parts: str, chain: str = "chain", k: float = P.MIXING_K) -> str:
    return f"""
{name}_b AS (SELECT c.req, c.level, CASE WHEN c.level = max(c.level) OVER (PARTITION BY c.req) THEN 1 ELSE coalesce(n, 0) / (coalesce(n, 0) + {k}) END AS beta
  FROM {chain} c LEFT JOIN (SELECT req, level, max(n) AS n FROM {parts} GROUP BY ALL) p USING (req, level)),
{name}_l AS (SELECT req, level, beta * coalesce(product(1 - beta) OVER (PARTITION BY req ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS weight FROM {name}_b),
{name} AS (SELECT req, token, sum(weight * amount) AS p FROM {parts} JOIN {name}_l USING (req, level) WHERE amount IS NOT NULL AND NOT (k = 1 AND cont = 0) GROUP BY req, token)"""


def renorm_sql(name: str, src: str) -> str:
    return f"""{name} AS (SELECT req, token, CASE WHEN t <= 0 OR abs(1 - t) < 1e-9 THEN p WHEN t < 1 THEN p + (1 - t) / n ELSE p / t END AS p FROM (
  SELECT *, sum(p) OVER (PARTITION BY req) AS t, count(*) OVER (PARTITION BY req) AS n FROM {src}))"""


def plain_sql(name: str, cap: int = 5, chain: str = "chain", k: float = P.MIXING_K) -> tuple[str, ...]:
    return parts_sql(f"{name}_p", chain, cap), mixed_sql(f"{name}_m", f"{name}_p", chain, k), renorm_sql(name, f"{name}_m")


def lift_sql(name: str, cap: int = 5) -> tuple[str, ...]:
    if cap <= 3:
        return plain_sql(name, cap)
    world = f"(SELECT * FROM {name}_some WHERE level = 3)"
    alone = lambda n, c: (parts_sql(f"{n}_p", world, c), f"{n}_d AS (SELECT req, token, sum(amount) AS p FROM {n}_p WHERE amount IS NOT NULL AND NOT (k = 1 AND cont = 0) GROUP BY ALL)", renorm_sql(n, f"{n}_d"))
    return (
        parts_sql(f"{name}_p", "chain", cap),
        mixed_sql(f"{name}_m", f"{name}_p"),
        f"{name}_yes AS (SELECT req FROM chain GROUP BY req HAVING count(*) > 1 AND max(level) = 3 AND least(len(any_value(hist)) + 1, {cap}) > 3)",
        f"{name}_some AS (SELECT * FROM chain WHERE req IN (SELECT req FROM {name}_yes))",
        *alone(f"{name}_full", cap),
        *alone(f"{name}_short", 3),
        parts_sql(f"{name}_cp", f"{name}_some", 3),
        mixed_sql(f"{name}_cm", f"{name}_cp", f"{name}_some"),
        f"{name}_r AS (SELECT req, token, f.p * greatest(coalesce(c.p, 0), 1e-9) / greatest(coalesce(s.p, 0), 1e-9) AS p FROM {name}_full f LEFT JOIN {name}_cm c USING (req, token) LEFT JOIN {name}_short s USING (req, token))",
        f"{name}_u AS (SELECT * FROM {name}_m WHERE req NOT IN (SELECT req FROM {name}_yes) UNION ALL SELECT req, token, p / sum(p) OVER (PARTITION BY req) FROM {name}_r)",
        renorm_sql(name, f"{name}_u"),
    )


HARD = "hard AS (SELECT req, token, cnt / total AS p FROM (SELECT c.req, n.token, cnt, total, level, min(level) OVER (PARTITION BY c.req) AS f FROM chain c JOIN ngrams n ON n.context = c.context AND n.\"order\" = 2 AND n.history = c.hist[-1]) WHERE level = f)"
UNI = "uni AS (SELECT token, cont / sum(cont) OVER () AS p FROM ngrams WHERE context = 'global' AND \"order\" = 1 AND cont > 0)"


def metrics_sql(name: str, dist: str) -> str:
    return f"""
{name}_r AS MATERIALIZED (SELECT req, token, p, row_number() OVER (PARTITION BY req ORDER BY p DESC, token) AS rank FROM {dist}),
{name} AS (SELECT place, rank, coalesce(1 / rank, 0) AS rr, CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END AS ndcg5, coalesce(CAST(rank <= 1 AS INT), 0) AS top1, coalesce(CAST(rank <= 3 AS INT), 0) AS top3,
  coalesce(CAST(rank <= 5 AS INT), 0) AS top5, CAST(rank IS NOT NULL AS INT) AS covered, -log2(greatest(coalesce(p, 0), pow(2, -30))) AS surprisal, coalesce(c, 0) AS confidence
  FROM (SELECT h.place, r.rank, r.p, b.p AS c FROM held h LEFT JOIN {name}_r r ON r.req = h.req AND r.token = h.actual LEFT JOIN {name}_r b ON b.req = h.req AND b.rank = 1))"""


AGG = "count(*) AS n, avg(rr) AS mrr, avg(ndcg5) AS ndcg5, avg(top1) AS top1, avg(top3) AS top3, avg(top5) AS top5, avg(covered) AS coverage, pow(2, avg(surprisal)) AS perplexity"
ALONE = "alone AS (SELECT * FROM chain WHERE context = 'global')"


def _compare_sql(named: list[tuple[str, tuple[str, ...], str]]) -> str:
    ctes = [c for name, made, dist in named for c in (*made, metrics_sql(f"m_{name}", dist))]
    return sql(*BASE, HARD, UNI, ALONE, *ctes, " UNION ALL ".join(f"SELECT {AGG}, '{name}' AS model FROM m_{name}" for name, _, _ in named))


LIFT = lift_sql("dist")
QUERIES = {
    f.__name__: f
    for f in (
        assign_split, split_filter, leak_check, sample_positions, context_chain, kn_context_distribution, context_mixing, renormalize, context_lift, distribution_batch, max_order_cap,
        predict_topn, predict_breakdown, hard_backoff, unigram_baseline, position_metrics, aggregate_metrics, ece, slice_metrics, model_comparison, policy_comparison, tune_mixing_k,
    )
}
ORACLE = {
    "assign_split": sql(EVENTS0, SPLIT_SQL, "SELECT * FROM spl"),
    "split_filter": sql(EVENTS0, SPLIT_SQL, "SELECT song, ordinal, pos, token FROM seq0 JOIN spl USING (song) WHERE split = 'train'"),
    "leak_check": sql(EVENTS0, SPLIT_SQL, "SELECT count(DISTINCT song) AS held, 0 AS leaked FROM seq0 JOIN spl USING (song) WHERE split <> 'train' AND pos >= 1"),
    "sample_positions": sql(EVENTS0, SPLIT_SQL, REQ_SQL, f"SELECT place, array_to_string(hist, ' ') AS hist, genre, section, actual, bucket FROM held ORDER BY md5('{SEED}:' || place), place LIMIT {N}"),
    "context_chain": sql(*BASE, "SELECT req, level, context FROM chain"),
    "kn_context_distribution": sql(*BASE, parts_sql("pt"), "SELECT req, context, token, sum(amount) AS p FROM pt WHERE amount IS NOT NULL AND NOT (k = 1 AND cont = 0) GROUP BY ALL"),
    "context_mixing": sql(*BASE, parts_sql("pt"), mixed_sql("mx", "pt"), "SELECT * FROM mx"),
    "renormalize": sql(*BASE, parts_sql("pt"), "g AS (SELECT req, token, sum(amount) AS p FROM pt WHERE k > 1 AND context = 'global' GROUP BY ALL)", renorm_sql("out", "g"), "SELECT * FROM out"),
    "context_lift": sql(*BASE, *LIFT, "SELECT * FROM dist"),
    "distribution_batch": sql(*BASE, *plain_sql("dist"), "SELECT * FROM dist"),
    "max_order_cap": sql(*BASE, *plain_sql("dist", 2), "SELECT * FROM dist"),
    "predict_topn": sql(
        *BASE, *LIFT, parts_sql("pt"),
        "best AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY p DESC, token) AS rank FROM dist)",
        "sup AS (SELECT req, token, cnt, context || ':' || k AS seen_in FROM (SELECT *, row_number() OVER (PARTITION BY req, token ORDER BY level, k DESC) AS r FROM pt WHERE k > 1) WHERE r = 1)",
        "SELECT req, rank, token, p, coalesce(cnt, 0) AS support, seen_in FROM best LEFT JOIN sup USING (req, token) WHERE rank <= 3",
    ),
    "predict_breakdown": sql(
        *BASE, *LIFT, parts_sql("pt"),
        "best AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY p DESC, token) AS rank FROM dist)",
        "SELECT req, token, level, context, k AS \"order\", cnt, total FROM pt JOIN (SELECT req, token FROM best WHERE rank <= 3) USING (req, token) JOIN (SELECT context, \"order\" AS k, history, token, total FROM ngrams) g USING (context, k, history, token) WHERE k > 1",
    ),
    "hard_backoff": sql(*BASE, HARD, "SELECT * FROM hard"),
    "unigram_baseline": sql(*BASE, UNI, "SELECT * FROM uni"),
    "position_metrics": sql(*BASE, *LIFT, metrics_sql("met", "dist"), "SELECT * FROM met"),
    "aggregate_metrics": sql(*BASE, *LIFT, metrics_sql("met", "dist"), f"SELECT {AGG} FROM met"),
    "ece": sql(*BASE, *LIFT, metrics_sql("met", "dist"), "SELECT sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT least(floor(confidence * 10), 9) AS b, count(*) AS n, avg(confidence) AS c, avg(top1) AS a FROM met GROUP BY 1)"),
    "slice_metrics": sql(
        *BASE, *LIFT, metrics_sql("met", "dist"),
        "vals AS (SELECT place, unnest(['genre', 'section', 'bucket']) AS dimension, unnest([genre, section, CAST(bucket AS VARCHAR)]) AS value FROM held)",
        "oft AS (SELECT dimension, value FROM (SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS r FROM vals WHERE value IS NOT NULL GROUP BY 1, 2) WHERE r <= 2)",
        f"SELECT v.dimension, coalesce(o.value, 'other') AS slice, {AGG} FROM met JOIN vals v USING (place) LEFT JOIN oft o ON o.dimension = v.dimension AND o.value = v.value GROUP BY 1, 2",
    ),
    "model_comparison": _compare_sql([("unigram", ("d_uni AS (SELECT req, token, p FROM reqs CROSS JOIN uni)",), "d_uni"), ("hard_backoff", (), "hard"),
        *[x for o in range(2, 6) for x in ((f"kn{o}", plain_sql(f"a{o}", o, "alone"), f"a{o}"), (f"kn{o}_context", lift_sql(f"c{o}", o), f"c{o}"))]]),
    "policy_comparison": _compare_sql([("lift", LIFT, "dist"), ("interpolation", plain_sql("pl"), "pl"), ("global", plain_sql("gl", 5, "alone"), "gl"), ("v1", (), "hard")]),
    "tune_mixing_k": sql(*BASE, *[c for i, k in enumerate(KS) for c in (*plain_sql(f"k{i}", 5, "chain", k), metrics_sql(f"km{i}", f"k{i}"))],
        "SELECT k, mrr FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, round(avg(rr), 9) AS mrr FROM km{i}" for i, k in enumerate(KS)) + ") ORDER BY mrr DESC, k LIMIT 1"),
}
