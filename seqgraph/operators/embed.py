"""Embeddings of tokens from the transition graph and from sequences, and what is built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = (0.2, 0.3, 0.3, 0.2)


def fastrp(edges: DataFrame, dims: int = 64, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """token, dim, value (unit length): random signs smoothed by walks of 0, 1, 2, … steps over the undirected graph.

    edges: src, dst, count; weights ln(1 + count) of both directions together, no loops, rows summing to 1. Signs come from md5.
    """
    e = edges.filter("src <> dst")
    both = e.select("src", "dst", "count").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "count")).groupBy("src", "dst").agg(F.sum("count").alias("count"))
    w = both.withColumn("w", F.log1p("count")).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "w")
    nodes = edges.select(F.col("src").alias("token")).union(edges.select("dst")).distinct()
    sign = F.when(F.substring(F.md5(F.concat_ws(":", "token", "dim")), 1, 1) < "8", 1.0).otherwise(-1.0)
    now = nodes.select("token", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")).withColumn("x", sign)
    parts = [now.withColumn("x", F.col("x") * steps[0])]
    for share in steps[1:]:
        now = w.join(now.withColumnRenamed("token", "dst"), "dst").groupBy(F.col("src").alias("token"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        parts.append(now.withColumn("x", F.col("x") * share))
    total = reduce(DataFrame.unionByName, parts).groupBy("token", "dim").agg(F.sum("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("token")))
    return total.select("token", "dim", F.when(norm > 0, F.col("x") / norm).otherwise(0.0).alias("value"))


def pattern_vectors(patterns: DataFrame, vectors: DataFrame, frequency: DataFrame, a: float = 0.001) -> DataFrame:
    """pattern, dim, value (unit length): .85 of the mean of its tokens' vectors, weighted a / (a + share), and .15 of half the way from first to last.

    Tokens without a vector are passed over; patterns without any known token are left out. frequency: token, n.
    """
    total = frequency.agg(F.sum("n").alias("all"))  # one row
    share = frequency.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("all"))
    places = patterns.select("pattern", F.posexplode(F.split("pattern", " ")).alias("place", "token"))
    known = places.join(vectors, "token").join(share.select("token", "share"), "token").withColumn("w", a / (a + F.col("share")))
    by = known.groupBy("pattern", "dim").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"), F.min_by("value", "place").alias("first"), F.max_by("value", "place").alias("last"))
    mixed = by.withColumn("x", 0.85 * F.col("mean") + 0.15 * (F.col("last") - F.col("first")) / 2)
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("pattern")))
    return mixed.select("pattern", "dim", F.when(norm > 0, F.col("x") / norm).otherwise(0.0).alias("value"))


def chord2vec(sections: DataFrame, size: int = 64, window: int = 4, min_count: int = 20, epochs: int = 10, seed: int = 7) -> DataFrame:
    """token, vec: skip-gram vectors of unit length, trained on token lists."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    from .graph import normalized

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol="tokens", outputCol="v").fit(sections)
    return normalized(model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vec")))


def project_2d(vectors: DataFrame) -> DataFrame:
    """id, x, y: the first two principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("v"))
    p = vector_to_array("p")
    return PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("id", p[0].alias("x"), p[1].alias("y"))


def surface_similarity(queries: DataFrame, patterns: DataFrame) -> DataFrame:
    """query, pattern, overlap (multiset Jaccard of tokens), shared (distinct tokens), rotation (one is the other turned)."""
    counted = lambda d, name: d.select(F.col("pattern").alias(name), F.explode(F.split("pattern", " ")).alias("token")).groupBy(name, "token").agg(F.count(F.lit(1)).alias(f"n_{name}"))
    size = lambda d, name: d.select(F.col("pattern").alias(name), F.size(F.split("pattern", " ")).alias(f"size_{name}"))
    q, p = counted(queries, "query"), counted(patterns, "pattern")
    met = q.join(p, "token").groupBy("query", "pattern").agg(F.sum(F.least("n_query", "n_pattern")).alias("common"), F.count(F.lit(1)).alias("shared"))
    met = met.join(size(queries, "query"), "query").join(size(patterns, "pattern"), "pattern").filter("query <> pattern")
    turned = (F.col("size_query") == F.col("size_pattern")) & F.contains(F.concat(F.lit(" "), F.col("query"), F.lit(" "), F.col("query"), F.lit(" ")), F.concat(F.lit(" "), F.col("pattern"), F.lit(" ")))
    return met.select("query", "pattern", (F.col("common") / (F.col("size_query") + F.col("size_pattern") - F.col("common"))).alias("overlap"), "shared", turned.alias("rotation"))


def greedy_diverse(candidates: DataFrame, k: int = 5, penalty: float = 0.8) -> DataFrame:
    """query, rank, token: at each step the candidate with the largest score less penalty times its largest Jaccard overlap with those chosen.

    candidates: query, token, score, mask (a 12-bit set); a query's candidates are a short list. Ties go to the smaller token.
    """
    lists = candidates.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("token", "score", "mask"))).alias("c"))
    jaccard = lambda a, b: F.coalesce(F.try_divide(F.bit_count(a.bitwiseAND(b)), F.bit_count(a.bitwiseOR(b))), F.lit(0.0))
    empty = F.array().cast("array<struct<token:string,score:double,mask:int>>")

    def step(chosen: Column, _: Column) -> Column:
        rest = F.filter("c", lambda x: ~F.exists(chosen, lambda y: y["token"] == x["token"]))
        worth = lambda x: x["score"] - penalty * F.coalesce(F.array_max(F.transform(chosen, lambda y: jaccard(x["mask"], y["mask"]))), F.lit(0.0))
        # the list is in order of tokens, and the smallest of (-worth, token) comes first
        best = F.array_min(F.transform(rest, lambda x: F.struct((-worth(x)).alias("w"), x["token"].alias("token"), x["score"].alias("score"), x["mask"].alias("mask"))))
        return F.when(best.isNull(), chosen).otherwise(F.concat(chosen, F.array(F.struct(best["token"].alias("token"), best["score"].alias("score"), best["mask"].alias("mask")))))

    picked = lists.select("query", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(k)), empty, step)).alias("rank", "x"))
    return picked.select("query", (F.col("rank") + 1).alias("rank"), "x.token")


def candidate_union(*sources: tuple[str, DataFrame]) -> DataFrame:
    """req, token, sources (names in order, comma-joined), score (largest): the candidates that any source gives."""
    rows = reduce(DataFrame.unionByName, [d.select("req", "token", "score", F.lit(n).alias("source")) for n, d in sources])
    return rows.groupBy("req", "token").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("score").alias("score"))


def plausibility(candidates: DataFrame, drop: float = 0.05) -> DataFrame:
    """req, token, p (softmax of logit over the request), z (p's standard score over those that stay); the least likely share is dropped."""
    w = Window.partitionBy("req")
    p = candidates.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
    rank, n = F.row_number().over(w.orderBy("p", F.desc("token"))), F.count(F.lit(1)).over(w)
    stay = p.withColumn("r", rank).withColumn("n", n).filter(F.col("r") > F.floor(F.col("n") * drop))
    spread = F.stddev_pop("p").over(w)
    return stay.select("req", "token", "p", F.when(spread > 0, (F.col("p") - F.avg("p").over(w)) / spread).otherwise(0.0).alias("z"))
