"""A training-data pipeline over documents: rules, near-duplicates, decontamination, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgraph.llm.common import load, stored
from seqgraph.llm.decontaminate import decontaminate
from seqgraph.llm.mixing import mixed_documents
from seqgraph.llm.quality_rules import judged
from seqgraph.llm.simhash import one_of_each
from seqgraph.llm.token_files import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and that their host's verdict lets pass."""
    return judged(docs, keep=tuple(docs.columns)).filter("kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, without the words that are hit; n_chars, where there is one, follows the text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = decontaminate(docs, load(spark, sf_dir, "benchmark"), keep=rest).filter(~F.col("contaminated"))
    text = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[text.get(c, F.col(c)).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read from the token files. Workers still hold memory of the stages before, so pieces are few."""
    return token_digest(docs, pieces=200_000)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
    ("token files", token_output),
]

#: Fingerprints, the flow and the tokenizer aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
