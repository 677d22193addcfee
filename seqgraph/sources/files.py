"""Readers of corpus files: CSV and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_COLUMNS = ("id", "chords", "main_genre", "genres", "release_date", "decade")


def _blank_null(c: str):
    return F.nullif(F.trim(c), F.lit(""))


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """song, chords, genre (main genre, else genres), release (date, else the decade as a whole number); blanks are null."""
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in CSV_COLUMNS), escape='"', multiLine=True)
    decade = F.coalesce(F.expr("cast(cast(try_cast(trim(decade) AS double) AS int) AS string)"), _blank_null("decade"))
    return raw.select(F.col("id").alias("song"), "chords", F.coalesce(_blank_null("main_genre"), _blank_null("genres")).alias("genre"), F.coalesce(_blank_null("release_date"), decade).alias("release"))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """song, chords: the first of three fields that is there; blank and broken lines are skipped."""
    fields = ("chords", "progression", "chord_progression")
    raw = spark.read.json(path, schema=", ".join(f"{c} string" for c in ("song_id", "id", *fields)), mode="PERMISSIVE")
    return raw.select(F.coalesce("song_id", "id").alias("song"), F.coalesce(*map(_blank_null, fields)).alias("chords")).filter("chords IS NOT NULL")
