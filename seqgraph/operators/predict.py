"""Next-token distributions for a table of requests: interpolated Kneser-Ney by context, mixed down a backoff chain.

Requests are rows (req, hist: array of the tokens before, genre, section); n-grams are as sequence.ngram_counts makes them.
Positions that ask the same are one request. Their n-gram rows are looked up once (evidence); every variant of the model
(orders, contexts, mixing) is arithmetic over those rows, which stay on the partition of their request.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequence import MAX_ORDER_GLOBAL, MAX_ORDER_OTHER, max_order

MIXING_K = 100.0


def assign_split(song: Column) -> Column:
    """test, dev or train by sha256(song) mod 20 (0, 1, else), from the digest's hex digits: 16 is 0 mod 4 and 1 mod 5."""
    digest = F.sha2(song.cast("string"), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.conv(digest.substr(i, F.lit(1)), 16, 10).cast("int"))
    bucket = (5 * (F.element_at(digits, -1) % 4) + 16 * (F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 5)) % 20
    return F.when(bucket == 0, "test").when(bucket == 1, "dev").otherwise("train")


def request_key(hist: str) -> Column:
    """What a row with genre and section asks, as one string."""
    return F.concat_ws("|", F.array_join(hist, " "), F.coalesce("genre", F.lit("")), F.coalesce("section", F.lit("")))


def held_positions(positions: DataFrame, depth: int = 4) -> DataFrame:
    """Every position after the first of its section: place, req (what it asks: hist, genre and section), hist (depth tokens at most), genre, section, actual, bucket."""
    back = Window.partitionBy("song", "ordinal").orderBy("pos").rowsBetween(-depth, -1)
    p = positions.withColumn("hist", F.collect_list("token").over(back)).filter("pos >= 1")
    return p.select(F.concat_ws(":", "song", "ordinal", "pos").alias("place"), request_key("hist").alias("req"), "hist", "genre", "section", F.col("token").alias("actual"), F.least("pos", F.lit(4)).alias("bucket"))


def sample_positions(held: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n of held_positions(), least md5 of seed and place first."""
    return held.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("place"))), "place").limit(n)


def context_chain(requests: DataFrame, contexts: DataFrame) -> DataFrame:
    """req, hist, level, context: genre x section, genre, section, global as far as given and kept."""
    g, s = F.col("genre"), F.col("section")
    keys = F.array(F.concat(F.lit("genre_section:"), g, F.lit(":"), s), F.concat(F.lit("genre:"), g), F.concat(F.lit("section:"), s), F.lit("global"))
    return requests.select("req", "hist", F.posexplode(keys).alias("level", "context")).filter(F.col("context").isNotNull()).join(contexts.select("context"), "context", "left_semi")


def evidence(chain: DataFrame, ngrams: DataFrame, stats: DataFrame) -> DataFrame:
    """The n-gram rows of each level and order: req, level, last (level), depth, context, order, token, cnt, cont, total, distinct_next, d (discount)."""
    last = F.max("level").over(Window.partitionBy("req"))
    steps = chain.withColumn("last", last).withColumn("depth", F.size("hist"))
    steps = steps.withColumn("order", F.explode(F.sequence(F.lit(1), F.least(F.col("depth") + 1, max_order(F.col("context"))))))
    history = F.array_join(F.slice("hist", F.size("hist") - F.col("order") + 2, F.col("order") - 1), " ")
    steps = steps.withColumn("history", F.when(F.col("order") == 1, "").otherwise(history)).drop("hist")
    d = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    rows = steps.join(ngrams, ["context", "order", "history"]).join(stats.select("context", "order", d.alias("d")), ["context", "order"])
    return rows.select("req", "level", "last", "depth", "context", "order", "token", "cnt", "cont", "total", "distinct_next", "d").repartition("req")


@dataclass(frozen=True)
class Variant:
    """One model: the highest order, the mixing constant, whether contexts count, and whether the global order is lifted by them."""

    name: str = ""
    cap: int = MAX_ORDER_GLOBAL
    k: float = MIXING_K
    contexts: bool = True
    lift: bool = True


def _level() -> Window:
    return Window.partitionBy("req", "level")


def _req() -> Window:
    return Window.partitionBy("req")


def _amounts(rows: DataFrame, caps: set[int]) -> DataFrame:
    """rows with amount_{cap} (Kneser-Ney term of the row; null for rows that don't count) and n_{cap} (observations of the level's longest history).

    The weight of an order is the product of the longer orders' back-off shares; orders without evidence are passed over.
    """
    share = {k: F.coalesce(F.max(F.when(F.col("order") == k, F.col("d") * F.col("distinct_next") / F.col("total"))).over(_level()), F.lit(1.0)) for k in range(2, MAX_ORDER_GLOBAL + 1)}
    all_cont = F.sum(F.when(F.col("order") == 1, F.col("cont"))).over(_level())
    own = F.when(F.col("order") == 1, F.when((all_cont > 0) & (F.col("cont") > 0), F.col("cont") / all_cont)).otherwise(F.greatest(F.col("cnt") - F.col("d"), F.lit(0.0)) / F.col("total"))
    out = rows.withColumns({"own": own, **{f"s{k}": x for k, x in share.items()}})
    made = {}
    for cap in sorted(caps):
        limit = F.least(F.lit(cap), max_order(F.col("context")))
        weight = F.lit(1.0)
        for k in range(2, cap + 1):
            weight = weight * F.when((F.col("order") < k) & (F.lit(k) <= limit), F.col(f"s{k}")).otherwise(1.0)
        made[f"amount_{cap}"] = F.when(F.col("order") <= limit, weight * F.col("own"))
        made[f"n_{cap}"] = F.coalesce(F.max(F.when(F.col("order") == F.least(F.col("depth"), limit - 1) + 1, F.col("total"))).over(_level()), F.lit(0))
    return out.withColumns(made)


def _level_weight(cap: int, k: float) -> Column:
    """n / (n + k) at each level, times what the more specific levels leave; the last level takes the rest."""
    levels = F.array_sort(F.collect_set(F.struct("level", F.col(f"n_{cap}").alias("n"))).over(_req()))
    beta = lambda level, n: F.when(level == F.col("last"), 1.0).when(n + k > 0, n / (n + F.lit(float(k)))).otherwise(0.0)
    before = F.filter(levels, lambda x: x["level"] < F.col("level"))
    left = F.aggregate(before, F.lit(1.0), lambda acc, x: acc * (1 - beta(x["level"], x["n"])))
    return beta(F.col("level"), F.col(f"n_{cap}")) * left


def contributions(rows: DataFrame, cap: int = MAX_ORDER_GLOBAL) -> DataFrame:
    """req, level, context, order, token, amount, cnt, n: the Kneser-Ney terms of each order."""
    out = _amounts(rows, {cap}).filter(F.col(f"amount_{cap}").isNotNull())
    return out.select("req", "level", "context", "order", "token", F.col(f"amount_{cap}").alias("amount"), "cnt", F.col(f"n_{cap}").alias("n"))


def mixed(rows: DataFrame, k: float = MIXING_K, cap: int = MAX_ORDER_GLOBAL) -> DataFrame:
    """req, token, p: the levels' distributions mixed down the chain."""
    out = _amounts(rows, {cap}).withColumn("w", _level_weight(cap, k)).filter(F.col(f"amount_{cap}").isNotNull())
    return out.groupBy("req", "token").agg(F.sum(F.col("w") * F.col(f"amount_{cap}")).alias("p"))


def _normal(p: Column, by: Window) -> Column:
    """Missing mass is spread over the tokens seen, too much is scaled down; a sum within 1e-9 of 1 stays. Null where the token isn't seen."""
    total, n = F.sum(p).over(by), F.count(p).over(by)
    return F.when((total <= 0) | (F.abs(1 - total) < 1e-9), p).when(total < 1, p + (1 - total) / n).otherwise(p / total)


def renormalized(dist: DataFrame, p: str = "p") -> DataFrame:
    return dist.withColumn(p, _normal(F.col(p), _req()))


def distributions(rows: DataFrame, variants: list[Variant]) -> DataFrame:
    """model, req, token, p for each variant, all from one pass over the evidence.

    With lift, where the global order exceeds what contexts have, the full global distribution is scaled
    by the contexts' ratio to the global one of their order (floors 1e-9) and summed to 1.
    """
    low = lambda v: min(v.cap, MAX_ORDER_OTHER)
    lifted = [v for v in variants if v.contexts and v.lift and v.cap > MAX_ORDER_OTHER]
    out = _amounts(rows, {v.cap for v in variants} | {low(v) for v in lifted})
    mixes = sorted({(v.cap, v.k) for v in variants if v.contexts} | {(low(v), v.k) for v in lifted})
    at = {m: i for i, m in enumerate(mixes)}
    out = out.withColumns({f"w{i}": _level_weight(*m) for m, i in at.items()})
    levels = F.size(F.collect_set("level").over(_req()))
    out = out.withColumns({"levels": levels})
    sums = {f"mix{i}": F.sum(F.col(f"w{i}") * F.col(f"amount_{cap}")) for (cap, _), i in at.items()}
    sums |= {f"world{c}": F.sum(F.when(F.col("level") == 3, F.col(f"amount_{c}"))) for c in {v.cap for v in variants} | {low(v) for v in lifted}}
    out = out.groupBy("req", "token").agg(*[x.alias(n) for n, x in sums.items()], F.max("levels").alias("levels"), F.max("last").alias("last"), F.max("depth").alias("depth"))
    floor = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-9))
    first, second = {}, {}
    for i, v in enumerate(variants):
        if not v.contexts:
            first[f"p{i}"] = F.col(f"world{v.cap}")
        elif v not in lifted:
            first[f"p{i}"] = F.col(f"mix{at[v.cap, v.k]}")
        else:
            full, short = (_normal(F.col(f"world{c}"), _req()) for c in (v.cap, low(v)))
            ratio = full * floor(F.col(f"mix{at[low(v), v.k]}")) / floor(short)
            rises = (F.col("levels") > 1) & (F.col("last") == 3) & (F.least(F.col("depth") + 1, F.lit(v.cap)) > MAX_ORDER_OTHER)
            first[f"p{i}"] = F.when(rises, ratio).otherwise(F.col(f"mix{at[v.cap, v.k]}"))
            second[f"p{i}"] = F.when(rises, F.col(f"p{i}") / F.sum(f"p{i}").over(_req())).otherwise(F.col(f"p{i}"))
    out = out.withColumns(first).withColumns(second) if second else out.withColumns(first)
    out = out.withColumns({f"p{i}": _normal(F.col(f"p{i}"), _req()) for i in range(len(variants))})
    each = F.explode(F.array(*[F.struct(F.lit(v.name).alias("model"), F.col(f"p{i}").alias("p")) for i, v in enumerate(variants)])).alias("x")
    return out.select("req", "token", each).select("x.model", "req", "token", "x.p").filter("p IS NOT NULL")


def distribution(rows: DataFrame, k: float = MIXING_K, cap: int = MAX_ORDER_GLOBAL, lift: bool = True) -> DataFrame:
    """req, token, p of one variant."""
    return distributions(rows, [Variant("", cap, k, True, lift)]).drop("model")


def top_n(dist: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """req, rank, token, p, support, seen_in: support is the token's count at the most specific step above the unigram that saw it, seen_in that step (context:order)."""
    best = dist.withColumn("rank", F.row_number().over(Window.partitionBy("req").orderBy(F.desc("p"), "token"))).filter(F.col("rank") <= n)
    step = F.struct("cnt", F.concat_ws(":", "context", "order").alias("seen_in"))
    seen = rows.filter("order > 1").groupBy("req", "token").agg(F.min_by(step, F.struct("level", -F.col("order"))).alias("s"))
    return best.join(seen, ["req", "token"], "left").select("req", "rank", "token", "p", F.coalesce("s.cnt", F.lit(0)).alias("support"), "s.seen_in")


def breakdown(dist: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """req, token, level, context, order, cnt, total: the steps above the unigram that saw each of the n best tokens."""
    best = dist.withColumn("rank", F.row_number().over(Window.partitionBy("req").orderBy(F.desc("p"), "token"))).filter(F.col("rank") <= n)
    return rows.filter("order > 1").join(best.select("req", "token"), ["req", "token"], "left_semi").select("req", "token", "level", "context", "order", "cnt", "total")


def hard_backoff(rows: DataFrame) -> DataFrame:
    """req, token, p: relative bigram counts of the first context in the chain that has seen the last token."""
    pairs = rows.filter("order = 2").withColumn("first", F.min("level").over(_req())).filter("level = first")
    return pairs.select("req", "token", (F.col("cnt") / F.col("total")).alias("p"))


def unigram(ngrams: DataFrame) -> DataFrame:
    """token, p: shares of the global continuation counts."""
    rows = ngrams.filter("context = 'global' AND order = 1 AND cont > 0")
    total = rows.agg(F.sum("cont").alias("all"))
    return rows.join(F.broadcast(total)).select("token", (F.col("cont") / F.col("all")).alias("p"))  # one row


FLOOR = 2.0**-30


def _measured(positions: DataFrame) -> DataFrame:
    """Metrics from rank and p of the actual token (null if unseen) and the confidence in the best one."""
    within = lambda n: F.coalesce((F.col("rank") <= n).cast("int"), F.lit(0))
    ndcg = F.when(F.col("rank") <= 5, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    rr = F.coalesce(1 / F.col("rank"), F.lit(0.0))
    surprisal = -F.log2(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR)))
    return positions.select("model", "place", "rank", rr.alias("rr"), ndcg.alias("ndcg5"), within(1).alias("top1"), within(3).alias("top3"), within(5).alias("top5"), F.col("rank").isNotNull().cast("int").alias("covered"), surprisal.alias("surprisal"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def position_metrics(dists: DataFrame, positions: DataFrame, models: list[str]) -> DataFrame:
    """model, place, rank (null if unseen), rr, ndcg5, top1, top3, top5, covered, surprisal, confidence (of the best token), for every position and model."""
    w = Window.partitionBy("model", "req")
    ranked = dists.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "token")))
    best = ranked.filter("rank = 1").select("model", "req", F.col("p").alias("confidence"))
    asked = positions.select("place", "req", F.col("actual").alias("token"), F.explode(F.array(*map(F.lit, models))).alias("model"))
    return _measured(asked.join(ranked, ["model", "req", "token"], "left").join(best, ["model", "req"], "left"))


def unigram_metrics(tokens: DataFrame, positions: DataFrame, model: str = "unigram") -> DataFrame:
    """position_metrics() of one distribution (token, p) for all requests."""
    ranked = tokens.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("p"), "token")))  # a row for each token of the vocabulary
    best = ranked.agg(F.max("p").alias("confidence"))
    asked = positions.select("place", F.col("actual").alias("token"), F.lit(model).alias("model"))
    return _measured(asked.join(ranked, "token", "left").join(F.broadcast(best)))  # one row


def aggregated(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over positions, and perplexity 2 ** mean surprisal."""
    mean = lambda c, name=None: F.avg(c).alias(name or c)
    grouped = metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), mean("rr", "mrr"), mean("ndcg5"), mean("top1"), mean("top3"), mean("top5"), mean("covered", "coverage"), F.pow(F.lit(2.0), F.avg("surprisal")).alias("perplexity"))
    return grouped


def ece(metrics: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected calibration error of the best token's probability over equal-width bins."""
    b = metrics.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("top1").alias("a"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def slices(metrics: DataFrame, values: DataFrame, dimension: str, top: int) -> DataFrame:
    """Aggregates by the most frequent values of a dimension; the others (and null) together."""
    rows = metrics.join(values.select("place", F.col(dimension).cast("string").alias("value")), "place")
    often = rows.filter("value IS NOT NULL").groupBy("value").count().orderBy(F.desc("count"), "value").limit(top).select(F.col("value").alias("v"))
    named = rows.join(F.broadcast(often), F.col("value") == F.col("v"), "left").withColumn("slice", F.coalesce("v", F.lit("other")))
    return aggregated(named, "slice").withColumn("dimension", F.lit(dimension))
