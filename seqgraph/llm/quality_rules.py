"""Quality rules for documents, and verdicts on their hosts.

Each document is measured on its own. The share of a host's documents that fail is shrunk towards the
corpus by a beta prior fitted to the hosts themselves; the posterior and the prior give the host's verdict, which is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, small_batches, stored

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower")


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three words that is found twice or more; the first find counts too."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) ** 3 > 2**62:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[where] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The figures in MEASURES for one text as UTF-8 bytes."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda some: len(text) - len(text.translate(None, some))
    return (len(words), len(text) - without(_CONTINUATION + SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(UPPER), without(LOWER))


def _measured(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measure(x or b"") for x in b.column(text_col).cast(pa.binary()).to_pylist()]
        found = np.array(rows, np.int64).reshape(len(rows), len(MEASURES))
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=[*b.schema.names, *MEASURES])


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (no column named as one of MEASURES) and a long column for each of MEASURES; a null text measures as the empty one."""
    small_batches(docs.sparkSession)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(partial(_measured, text_col=text_col), kinds + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    """Rules on which the host's record has a say: symbols, equal lines, capitals."""
    return (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")) | ((F.col("n_upper") > F.col("n_lower")) & (F.col("n_upper") > 20))


def host_verdicts(measured: DataFrame, host_col: str = "source", sure: float = 2.0, far: float = 1.0, most: float = 0.5) -> DataFrame:
    """A row for each host (null is a host too): n_docs, n_failed, shrunk rate and verdict (trusted, mixed or blocked).

    The beta prior has the mean of the hosts' rates, and the weight at which its variance is theirs beyond
    what chance gives (method of moments). Where hosts don't differ beyond chance, or there is only one,
    the prior weighs as much as the mean host. The bars follow from it: a host is trusted if its posterior lies below the
    prior's mean by `sure` deviations of the posterior, and blocked if it lies by as many above the prior's mean plus `far` deviations
    of the prior, and above `most`. No documents: no rows.
    """
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((base_failed() | soft_failed()).cast("long")).alias("n_failed"))
    hosts = stored(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    p = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv")).first()
    mean = (p["f"] or 0) / p["n"] if p["n"] else 0.5
    chance = mean * (1 - mean) * (p["inv"] or 0)
    spread = (p["v"] or 0) - chance
    weight = max(1.0, mean * (1 - mean) / spread - 1) if spread > 1e-9 else max(1.0, (p["n"] or 0) / max(p["k"], 1))
    bar = max(most, mean + far * math.sqrt(mean * (1 - mean) / (weight + 1)))
    shrunk = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    off = F.lit(sure) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + weight + 1))
    verdict = F.when(F.col("rate") - off > bar, "blocked").when(F.col("rate") + off < mean, "trusted").otherwise("mixed")
    return hosts.withColumn("rate", shrunk).withColumn("verdict", verdict)


def judged(docs: DataFrame, host_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' kept columns, MEASURES, base_failed, soft_failed, host verdict and kept.

    A document goes if it fails a base rule, if its host is blocked, or if it fails a soft rule and its host
    isn't trusted. Null texts count as empty and so fail; a null host is a host of its own; repeated rows are
    judged each; an empty table gives no rows; other columns of docs, whatever their names, are left alone.
    Texts are measured once; the measures, with the kept columns, are written to the shared folder.
    """
    body = f"_in_{text_col}" if text_col in keep else "_body"
    given = docs.select(*[(F.col(c).cast("string") if c == text_col else F.col(c)).alias(f"_in_{c}") for c in keep], F.col(host_col).cast("string").alias("_host"), *([] if text_col in keep else [F.col(text_col).cast("string").alias("_body")]))
    measured = stored(with_measures(given, body).drop("_body"), "measured").withColumns({"base_failed": base_failed(), "soft_failed": soft_failed()})
    verdicts = stored(host_verdicts(measured, "_host").select("host", "rate", "verdict"), "verdicts")
    out = measured.join(verdicts, F.col("_host").eqNullSafe(F.col("host")), "left")
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & ~(F.col("soft_failed") & (F.col("verdict") != "trusted"))
    return out.withColumn("kept", kept).select(*[F.col(f"_in_{c}").alias(c) for c in keep], *[m for m in MEASURES if m not in keep], "base_failed", "kept", "soft_failed", F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
