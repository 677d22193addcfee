"""Versioned artifacts: Parquet tables with a manifest row each, checks before they are published, and versions of which one is active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fingerprint(columns: list[str]) -> F.Column:
    """A sum over rows that doesn't depend on their order: the first eight hex digits of md5 of the columns' texts."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long"))


def manifest(df: DataFrame, name: str, version: str, columns: list[str]) -> DataFrame:
    """One row: name, version, rows, fingerprint (of the columns that have one text in every engine), columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(fingerprint(columns), F.lit(0)).alias("fingerprint")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "rows", "fingerprint", F.lit(",".join(df.columns)).alias("columns"))


def write_artifact(df: DataFrame, folder: str, name: str, version: str, columns: list[str]) -> DataFrame:
    """Writes df (rows in the order of columns within files) and its manifest row under folder; the manifest, read back."""
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}/version={version}"
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(f"{path}/rows")
    manifest(spark.read.parquet(f"{path}/rows"), name, version, columns).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def validated(df: DataFrame, told: DataFrame, required: list[str], columns: list[str], budget_mb: float) -> DataFrame:
    """name, wanted, found, ok: required columns, rows, fingerprint and estimated size of an artifact against its manifest (one row)."""
    size = F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(8 * len(df.columns)))) * 1.4 / 1e6
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(fingerprint(columns), F.lit(0)).alias("f"), F.coalesce(size, F.lit(0.0)).alias("mb"))
    both = found.join(F.broadcast(told))  # one row each
    held = len([c for c in required if c in df.columns])
    rows = [("columns", F.lit(len(required)), F.lit(held)), ("rows", F.col("rows"), F.col("n")), ("fingerprint", F.col("fingerprint"), F.col("f"))]
    checks = [F.struct(F.lit(n).alias("name"), a.cast("double").alias("wanted"), b.cast("double").alias("found"), (a == b).alias("ok")) for n, a, b in rows]
    checks.append(F.struct(F.lit("size").alias("name"), F.lit(float(budget_mb)).alias("wanted"), F.round("mb", 6).alias("found"), (F.col("mb") <= budget_mb).alias("ok")))
    return both.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def published(attempts: DataFrame) -> DataFrame:
    """step, version, rows, outcome, active, kept: publishing one manifest after the other (step, version, rows, fingerprint).

    A version that isn't there yet is published and becomes the active one; one with an equal manifest changes nothing; one with another manifest
    is refused. kept: is it the active version at the end, which is all that a collection of old ones leaves? One row for each attempt.
    """
    of = Window.partitionBy("version").orderBy("step")
    first = attempts.withColumn("known", F.first(F.struct("rows", "fingerprint")).over(of)).withColumn("nth", F.row_number().over(of))
    told = first.withColumn("outcome", F.when(F.col("nth") == 1, "published").when(F.col("known") == F.struct("rows", "fingerprint"), "unchanged").otherwise("refused"))
    order = Window.orderBy("step")  # a row for each attempt
    new = F.when(F.col("outcome") == "published", F.col("version"))
    last = F.last(new, ignorenulls=True)
    return told.select("step", "version", "rows", "outcome", last.over(order).alias("active"), (F.col("version") == last.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("kept"))


def read_active(df: DataFrame, versions: DataFrame) -> DataFrame:
    """The rows of df (with a column version) of the active version; versions as published() gives them."""
    active = versions.orderBy(F.desc("step")).limit(1).select(F.col("active").alias("version"))
    return df.join(F.broadcast(active), "version")  # one row
