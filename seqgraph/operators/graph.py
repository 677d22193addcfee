"""Property graphs as two tables (nodes: id, type, label; edges: type, context, src, dst, count, prob): filters, neighbourhoods, paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graph_filter(nodes: DataFrame, edges: DataFrame, types: tuple[str, ...], min_prob: float = 0.0) -> DataFrame:
    """Edges of the types with prob >= min_prob whose ends are both in nodes; a null prob passes only if min_prob is 0."""
    kept = edges.filter(F.col("type").isin(*types) & F.coalesce(F.col("prob") >= min_prob, F.lit(min_prob == 0)))
    ids = nodes.select("id")
    return kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int = 2, min_prob: float = 0.0, limit: int = 50) -> DataFrame:
    """seed, hop, src, dst, prob: outgoing edges up to so many hops from each seed, not expanding a node twice; the `limit` likeliest of each seed."""
    e = edges.filter(F.col("prob") >= min_prob).select("src", "dst", "prob")
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("src"))
    seen, found = front, []
    for hop in range(1, hops + 1):
        out = front.join(e, "src").select("seed", F.lit(hop).alias("hop"), "src", "dst", "prob")
        found.append(out)
        front = out.select("seed", F.col("dst").alias("src")).distinct().join(seen, ["seed", "src"], "left_anti")
        seen = seen.unionByName(front)
    all_found = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("prob"), "hop", "src", "dst"))
    return all_found.withColumn("r", rank).filter(F.col("r") <= limit).drop("r")


def k_best_paths(edges: DataFrame, pairs: DataFrame, k: int = 3, max_edges: int = 6, levels: DataFrame | None = None, rising: bool = False, max_level: float | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda d, name: d) -> DataFrame:
    """src, dst, rank, path, cost: the k cheapest simple paths of up to max_edges edges, cost the sum of -ln prob (half more for edges that aren't transitions).

    A first pass gives each node's least cost to the targets within the edges left (a bound); partial paths survive
    while cost plus bound is at most the cost that k complete paths of the pair already have. levels: id, level of nodes, 0
    where there is none. With rising, no step goes to a lower level; with max_level, none goes to a level above it (the first node
    may lie above). Both are settled on the edges, so the bounds know them too and pruning stays exact. keep stores what
    each step hands on; without it the plan grows with every edge.
    """
    if (rising or max_level is not None) and levels is None:
        raise ValueError("constraints on levels need levels")
    cost = -F.log("prob") + F.when(F.col("type") == "TRANSITIONS_TO", 0.0).otherwise(0.5)
    e = edges.filter("prob > 0").groupBy("src", "dst").agg(F.min(cost).alias("c"))
    if levels is not None:
        level = lambda c: levels.select(F.col("id").alias(c), F.col("level").alias(f"level_{c}"))
        e = e.join(level("src"), "src", "left").join(level("dst"), "dst", "left").na.fill(0, ["level_src", "level_dst"])
        if rising:
            e = e.filter("level_src <= level_dst")
        if max_level is not None:
            e = e.filter(F.col("level_dst") <= max_level)
        e = e.select("src", "dst", "c")
    e = keep(e, "path-edges")
    bound = pairs.select(F.col("dst").alias("goal"), F.col("dst").alias("node")).distinct().withColumn("b", F.lit(0.0))
    bounds = [bound]
    for _ in range(max_edges - 1):
        step = bound.join(e.withColumnRenamed("dst", "node"), "node").select("goal", F.col("src").alias("node"), (F.col("b") + F.col("c")).alias("b"))
        bound = keep(bound.unionByName(step).groupBy("goal", "node").agg(F.min("b").alias("b")), "path-bounds")
        bounds.append(bound)
    paths = pairs.select("src", "dst", F.array("src").alias("path"), F.col("src").alias("node"), F.lit(0.0).alias("cost"))
    done = []
    for n in range(1, max_edges + 1):
        grown = paths.join(e.select(F.col("src").alias("node"), F.col("dst").alias("next"), "c"), "node")
        grown = grown.filter(~F.array_contains("path", F.col("next"))).select("src", "dst", F.concat("path", F.array("next")).alias("path"), F.col("next").alias("node"), (F.col("cost") + F.col("c")).alias("cost"))
        grown = keep(grown, "paths")
        done.append(grown.filter(F.col("node") == F.col("dst")).select("src", "dst", "path", "cost"))
        if n == max_edges:
            break
        best = reduce(DataFrame.unionByName, done).withColumn("r", F.row_number().over(Window.partitionBy("src", "dst").orderBy("cost"))).filter(F.col("r") == k)
        ahead = bounds[max_edges - n].select(F.col("goal").alias("dst"), "node", "b")
        paths = grown.filter(F.col("node") != F.col("dst")).join(ahead, ["dst", "node"]).join(best.select("src", "dst", F.col("cost").alias("u")), ["src", "dst"], "left")
        paths = paths.filter(F.col("u").isNull() | (F.col("cost") + F.col("b") <= F.col("u") + 1e-9)).select("src", "dst", "path", "node", "cost")
    total = reduce(DataFrame.unionByName, done).withColumn("key", F.array_join("path", " ")).withColumn("cost", F.round("cost", 9))
    rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy("cost", "key"))
    return total.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", "rank", F.col("key").alias("path"), "cost")


def explain_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """All edges between two nodes in one row: contexts, summed count and support."""
    some = edges.filter((F.col("src") == src) & (F.col("dst") == dst))
    return some.agg(F.array_join(F.sort_array(F.collect_set("context")), ",").alias("contexts"), F.sum("count").alias("count"), F.sum("support").alias("support"))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union by keys; rows of the second win."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_o")))).filter("_r = 1").drop("_o", "_r")


def normalized(vectors: DataFrame, col: str = "vec") -> DataFrame:
    """vec divided by its length as doubles; a zero vector stays."""
    v = F.transform(col, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn(col, F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """query, id, rank, cosine: nearest vectors of the query's own model, itself excluded; queries are a stated set against all rows."""
    q = normalized(queries).select(F.col("id").alias("query"), "model", F.col("vec").alias("qvec"))
    near = q.join(normalized(vectors), "model").filter(F.col("query") != F.col("id")).select("query", "id", F.round(dot("qvec", "vec"), 9).alias("cosine"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))).filter(F.col("rank") <= k)
