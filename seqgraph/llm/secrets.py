"""Secret scans: patterns for known kinds, and character Markov models for unknown ones.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are
trained from labelled samples. A run of token characters whose log-likelihood ratio favours the random
model is reported as a span of kind markov. All of it is DataFrame functions.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, texts

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the models; any other is the last state.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
STATES = len(ALPHABET) + 1
#: Runs that the models judge: as long as the shortest value that an assignment counts with.
LEAST = 12
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: The models are trained on the words of so many documents (those with the smallest hash of their id), and on so many base values.
SAMPLE_DOCS, SAMPLE_VALUES = 2_000, 20_000
#: A run is a secret if the ratio (natural log) is over the first in all and over the second for each character. The first is the odds
#: against a secret among ordinary runs, about a thousand to one; the second keeps long runs from adding up to it by small leanings.
TOTAL, MEAN = 7.0, 0.5


#: Matches that are put in place at a time: arrays grow by appending within a chunk only, so a text with many matches takes time in proportion to them.
CHUNK = 64
_SPANS = "array<struct<start:int,end:int,hit:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column) -> Column:
    """An array cut to arrays of at most CHUNK; null if it is empty."""
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK)), lambda c: F.slice(x, (c * CHUNK + 1).cast("int"), F.lit(CHUNK)))
    return _let(items, lambda x: F.when(F.size(x) > 0, cut(x)))


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of the pattern's matches, from what split() leaves between them; code points, end exclusive."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.char_length(x["gap"])
        hi = lo + F.char_length(x["hit"])
        return F.struct(hi.alias("at"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), x["hit"].alias("hit")))).alias("out"))

    # places within each chunk, then where each chunk begins
    local = F.transform(_chunks(F.filter(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda x: x["hit"].isNotNull())), lambda chunk: F.aggregate(chunk, start, step))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    begins = lambda chunks: F.aggregate(F.transform(chunks, lambda x: x["at"]), first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    moved = lambda x, at: F.transform(x["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["hit"].alias("hit")))
    return F.when(text.rlike(pattern), _let(local, lambda chunks: F.flatten(F.zip_with(chunks, begins(chunks), moved)))).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end): the contract's three kinds, in order."""
    of = lambda kind, found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    assign = F.filter(spans(text, ASSIGN), lambda x: F.char_length(F.regexp_extract(x["hit"], ASSIGN, 1)) >= 12)
    access = F.filter(spans(text, ACCESS), lambda x: x["end"] - x["start"] >= 18)
    return F.array_sort(F.concat(of(0, assign), of(1, access), of(2, spans(text, HEX))))


def value_of(hit: Column, kind: Column) -> Column:
    return F.when(kind == 0, F.regexp_extract(hit, ASSIGN, 1)).otherwise(hit)


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_values: int = SAMPLE_VALUES) -> DataFrame:
    """text, secret: what the base patterns found (true); words of documents in which they found nothing, too short to be a secret (false).

    As many strings that are random for certain, base64 of the words' hashes, are labelled true as well, so
    that the random model knows all characters even where the corpus holds few secrets.
    """
    d = texts(docs)
    found = d.select("text", F.explode(base_spans(F.col("text"))).alias("s"))
    hit = F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    values = found.select(F.when(F.col("s.kind") == 0, F.regexp_extract(hit, ASSIGN, 1)).otherwise(hit).alias("text")).distinct().orderBy(F.xxhash64("text"), "text").limit(sample_values)
    ids = d.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # stored, as the patterns would else be sought in every document once more
    some = stored(d.join(F.broadcast(ids), "doc_id", "left_semi"), "sample-texts").filter(F.size(base_spans(F.col("text"))) == 0)
    words = some.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("text")).filter(F.char_length("text") < LEAST).distinct()
    made = words.select(F.base64(F.unhex(F.sha2("text", 256))).alias("text"), F.lit(True).alias("secret"))
    return values.withColumn("secret", F.lit(True)).unionByName(words.withColumn("secret", F.lit(False))).unionByName(made)


def _pairs(text: Column) -> Column:
    """Indexes of the pairs of neighbouring characters' states: STATES * first + second."""
    state = lambda i: F.position(text.substr(i, F.lit(1)), F.lit(ALPHABET))  # noqa: E731  0: not in the alphabet
    return F.when(F.char_length(text) > 1, F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: state(i) * STATES + state(i + 1))).otherwise(F.array().cast("array<int>"))


def train_markov(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each pair of states, random against ordinary, in the order of _pairs(). Half a count for each state is
    added, shared out as the second states occur overall, so that what follows a rare character is judged by how common it is.

    samples: text, secret (null texts and labels count for neither). Without samples all ratios are 0.
    """
    pair = samples.filter(F.col("text").isNotNull()).select("secret", F.explode(_pairs(F.col("text"))).alias("pair"))
    seen = pair.groupBy("pair").agg(F.count_if(F.col("secret")).alias("r"), F.count_if(~F.col("secret")).alias("w"))
    grid = samples.sparkSession.range(STATES * STATES).select(F.col("id").cast("int").alias("pair")).join(seen, "pair", "left").fillna(0, ["r", "w"])
    after = Window.partitionBy(F.floor(F.col("pair") / STATES))
    into, every = Window.partitionBy(F.col("pair") % STATES), Window.partitionBy(F.lit(0))  # a row for each pair of states
    overall = lambda n: (F.sum(n).over(into) + 0.5) / (F.sum(n).over(every) + 0.5 * STATES)
    log_p = lambda n: F.log((F.col(n) + 0.5 * STATES * overall(n)) / (F.sum(n).over(after) + 0.5 * STATES))
    return [r[0] for r in grid.select((log_p("r") - log_p("w")).alias("llr"), "pair").orderBy("pair").collect()]


def chunked(base: Column) -> Column:
    """Spans in order of their starts, as chunks with the least start and the largest end."""
    return F.transform(_chunks(base), lambda c: F.struct(F.element_at(c, 1)["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), c.alias("spans")))


def outside(run: Column, base: Column) -> Column:
    """The parts of a run that no span of chunked() base covers, as (start, end, hit); the run itself where none meets it."""
    none = F.array().cast(_SPANS)
    part = lambda a, b: F.when(a < b, F.array(F.struct(a.alias("start"), b.alias("end"), run["hit"].substr(a - run["start"] + 1, b - a).alias("hit")))).otherwise(none)
    start = F.struct(run["start"].alias("at"), none.alias("out"))
    meets = lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])
    found = F.flatten(F.transform(F.filter(base, meets), lambda c: F.filter(c["spans"], meets)))
    step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))
    cut = lambda met: F.aggregate(met, start, step, lambda acc: F.concat(acc["out"], part(acc["at"], run["end"])))
    return _let(found, lambda met: F.when(F.coalesce(F.size(met), F.lit(0)) == 0, F.array(run)).otherwise(cut(met)))


def scan_secrets(docs: DataFrame, model: list[float] | None = None, total: float = TOTAL, mean: float = MEAN) -> DataFrame:
    """doc_id, text and found (array of start, kind as index into KINDS, end) for each row of docs, by start.

    model: of train_markov(); else it is trained from docs. Null texts are empty and have no spans; repeated rows
    are scanned each; an empty table gives no rows; other columns are dropped. Markov spans never overlap base ones: what these leave of a run is judged.
    """
    ratios = F.from_json(F.lit(str(model if model is not None else train_markov(labelled_samples(docs)))), "array<double>")
    one = lambda hit: F.aggregate(_pairs(hit), F.lit(0.0), lambda acc, i: acc + F.get(ratios, i))
    score = lambda hit: F.when(hit.rlike("[a-z]"), one(hit)).otherwise(F.least(one(hit), one(F.lower(hit))))  # noqa: E731  a word in capitals is still a word
    out = texts(docs).withColumn("base", base_spans(F.col("text")))
    pieces = _let(chunked(F.col("base")), lambda chunks: F.flatten(F.transform(spans(F.col("text"), RUN), lambda x: outside(x, chunks))))
    runs = F.transform(F.filter(pieces, lambda x: F.char_length(x["hit"]) >= LEAST), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), score(x["hit"]).alias("score")))
    likely = F.filter(runs, lambda x: (x["score"] > total) & (x["score"] > mean * (x["end"] - x["start"])))
    extra = F.transform(likely, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return out.select("doc_id", "text", "base", F.array_sort(F.concat("base", extra)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")
