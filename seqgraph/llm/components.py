"""Connected components of an edge table, by repeated star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node with an edge; root is the smallest node of its component (signed order for longs).

    Alternates large-star and small-star steps (each a shuffle and an aggregate) until the links are stars: every node
    points to one other, and none that is pointed to points on. Steps keep components as they are, so stars are the
    answer; their number grows with the logarithm of the longest path. Each step's edges are written to the
    shared folder. Null ends and loops are ignored; an empty table gives no rows.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while not _stars(e):
        # large star: every larger neighbour of u points to the smallest node near u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u > v").distinct(), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Does each u have one v, and is no v a u? Counts by node, which combine before the shuffle."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("met")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("met")))
    return ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("met").alias("met")).filter("points > 1 OR (points = 1 AND met = 1)").isEmpty()
