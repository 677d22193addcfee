"""Queries over events as logs and streams, over vectors, over the transition graph, and over artifacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import artifacts as A
from ..operators import examples as X
from ..operators import graph as G
from ..operators import neighbors as N
from ..operators import predict as P
from ..operators import sequence as S
from ..sources.fixtures import CHORD_SQL, CONTEXT_SQL, EVENT_SQL, chord_lines, event_positions, event_sections, isolated, materialize, table
from ..streaming import ops
from .prediction import SPLIT_SQL
from .sequences import KEPT_SQL, MIN_CONTEXT, MIN_SUPPORT, PAIR_SQL, PATTERN_SQL, TRANSITION_SQL, found_patterns, sql

# ---- logs and streams ----------------------------------------------------------------------------------------------


def request_metrics_24h(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    recent = e.join(F.broadcast(last), e.ts >= F.col("since"))  # one row
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return recent.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def usage_by_model(spark, sf):
    """Calls, cost and tokens by model: the per-row map where there is one, else the row's flat columns (every tenth k has none); and how many rows fell back."""
    e = table(spark, sf, "events").select(F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"), "event_type")
    k = F.col("k").cast("string")
    usage = F.when(F.col("k") % 10 != 0, F.concat(F.lit('{"m'), (F.col("k") % 3).cast("string"), F.lit('": {"calls": 1, "cost": "0.00'), k, F.lit('", "tokens": '), k, F.lit("}}")))
    parsed = F.from_json(usage, "map<string, struct<calls:int, cost:decimal(12,8), tokens:int>>")
    flat = F.create_map(F.concat(F.lit("flat-"), F.col("event_type")), F.struct(F.lit(1).alias("calls"), F.lit("0.01").cast("decimal(12,8)").alias("cost"), F.lit(0).alias("tokens")))
    each = e.select(usage.isNull().cast("int").alias("fell_back"), F.explode(F.coalesce(parsed, flat)).alias("model", "u"))
    return each.groupBy("model").agg(F.sum("u.calls").alias("calls"), F.sum("u.cost").cast("double").alias("cost"), F.sum("u.tokens").alias("tokens"), F.sum("fell_back").alias("fell_back"))


def tool_counts(spark, sf):
    """How often each tool is called; a row lists the tools it called."""
    tools = F.split(F.concat_ws(",", F.col("event_type"), F.when(F.col("value") > 50, F.lit("search")), F.when(F.col("user_id") % 2 == 0, F.lit("lookup"))), ",")
    return table(spark, sf, "events").select(F.explode(tools).alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def daily_cost(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("cost"), F.count(F.lit(1)).alias("n"))


def status_census(spark, sf):
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    return table(spark, sf, "events").groupBy(status.alias("status"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("slow"))


def hourly_counts(spark, sf):
    return ops.hourly_counts(table(spark, sf, "events"), 4).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet")


def _checkpoint(spark):
    materialize(spark.range(0), "probe")
    return spark.conf.get("spark.checkpoint.dir")


def stream_transitions(spark, sf):
    e = _event_stream(spark, sf).select(F.col("user_id").alias("song"), F.col("event_type").alias("token"), "ts", "event_id")
    pairs = ops.run_available(ops.stream_pairs(e), _checkpoint(spark))
    return pairs.groupBy("from_token", "to_token").agg(F.count(F.lit(1)).alias("count"))


#: Micro-batches that the events come in, by quarters of their time.
BATCHES = 4


def _quartered(spark, sf):
    """Events with the quarter of the table's time that they fall in."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = e.agg(F.min(F.unix_timestamp("ts")).alias("lo"), F.max(F.unix_timestamp("ts")).alias("hi"))  # one row
    part = F.floor(BATCHES * (F.unix_timestamp("ts") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
    return e.join(F.broadcast(bounds)).withColumn("slot", F.least(F.lit(BATCHES - 1), part)).drop("lo", "hi")


def stream_hourly_counts(spark, sf):
    """The last count told of each type and hour; of the first quarter, every 50th event comes with the last batch, far behind the watermark, and is dropped."""
    late = (F.col("event_id") % 50 == 0) & (F.col("slot") == 0)
    rows = _quartered(spark, sf).withColumn("slot", F.when(late, BATCHES - 1).otherwise(F.col("slot"))).select("event_type", "ts", "slot")
    told = ops.run_updates(ops.hourly_counts(ops.in_batches(rows, "slot", BATCHES, _checkpoint(spark)), 4), _checkpoint(spark))
    last = told.groupBy("event_type", "hour").agg(F.max_by(F.struct("n", "over_limit", "seconds_left"), "batch").alias("x"))
    return last.select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "x.*")


def stream_dedupe(spark, sf):
    """dedupe_within() over a stream of several batches."""
    rows = _quartered(spark, sf).withColumn("key", F.concat_ws(":", "user_id", "event_type")).select("key", "ts", "slot")
    kept = ops.run_available(ops.stream_kept_within(ops.in_batches(rows, "slot", BATCHES, _checkpoint(spark)), "key", 7 * 86400), _checkpoint(spark))
    return kept.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def dedupe_within(spark, sf):
    """Of each key (user and type), the rows that come seven days or more after the last one kept."""
    return ops.kept_within(table(spark, sf, "events").withColumn("key", F.concat_ws(":", "user_id", "event_type")), "key", 7 * 86400).select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def heavy_hitters(spark, sf):
    once = S.windows(event_sections(spark, sf)).groupBy("w").agg(F.sum("n").alias("n"))
    return once.groupBy(S.smallest_rotation(F.col("w"))["pattern"].alias("pattern")).agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_SUPPORT)


def heavy_hitters_sketch(spark, sf):
    """Of the windows by a summary of bounded size: how many occur often, how many of these the summary misses, and how many counts lie outside its bounds."""
    w = materialize(S.windows(event_sections(spark, sf)).select(F.col("w").alias("item"), "n"), "windows")
    exact = w.groupBy("item").agg(F.sum("n").alias("n"))
    both = exact.join(X.heavy_hitters(w, MIN_SUPPORT), "item", "full_outer")
    often = F.col("n") >= MIN_SUPPORT
    return both.agg(F.count_if(often).alias("frequent"), F.count_if(often & F.col("low").isNull()).alias("missed"), F.count_if(F.col("low").isNotNull() & ((F.col("n") < F.col("low")) | (F.col("n") > F.col("high")))).alias("outside"))



# ---- vectors -------------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("model"), F.col("embedding").alias("vec"))


def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return N.exact(v.filter("id % 50 = 0"), v, 10).select("query", "id", "cosine", "rank")


def cosine_topk_index(spark, sf):
    """The ten nearest of all labels for each vector whose id is divisible by 50, by the index."""
    v = _vectors(spark, sf).withColumn("model", F.lit(0))
    index = N.fit_index(v)
    return N.approximate(index, v.filter("id % 50 = 0"), materialize(N.indexed(index, v), "indexed"), 10).select("query", "id", "cosine", "rank")


def index_recall(spark, sf):
    """How many of the exact ten nearest the index finds, how many cells it has, and how many a query looks into."""
    v = _vectors(spark, sf).withColumn("model", F.lit(0))
    index = N.fit_index(v)
    q = v.filter("id % 50 = 0")
    found = N.approximate(index, q, materialize(N.indexed(index, v), "indexed"), 10)
    return N.recall(found, N.exact(q, v, 10)).withColumns({"cells": F.lit(len(index.centroids)), "probes": F.lit(index.probes)})


def similar_edges(spark, sf):
    v = _vectors(spark, sf)
    return N.exact(v, v, 10).select(F.col("query").alias("src"), F.col("id").alias("dst"), F.col("cosine").alias("weight"))


def seed_neighbors(spark, sf):
    v = _vectors(spark, sf)
    near = N.exact(v.filter("id % 50 = 0"), v, 10)
    return near.groupBy("id").agg(F.max("cosine").alias("similarity")).orderBy(F.desc("similarity"), "id").limit(50)


def pairwise_cosine(spark, sf):
    """Each vector whose id is divisible by 50 against all others of its model."""
    v = G.normalized(_vectors(spark, sf))
    q = v.filter("id % 50 = 0").select(F.col("id").alias("query"), F.col("model"), F.col("vec").alias("q"))
    return v.join(q, "model").select("query", "id", F.round(G.dot("q", "vec"), 9).alias("cosine"))


def l2_normalize(spark, sf):
    v = G.normalized(_vectors(spark, sf))
    return v.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(G.dot("vec", "vec"), 6).alias("norm"))


def vector_checks(spark, sf):
    v = _vectors(spark, sf)
    bad = F.exists("vec", lambda x: F.isnan(x) | x.isNull())
    size = F.sqrt(F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    return v.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("not_finite"), F.count_if(F.size("vec") != 64).alias("wrong_size"), F.count_if((size < 0.99) | (size > 1.01)).alias("not_unit"))


def embedding_eval(spark, sf):
    """Share of the five nearest vectors (any label) with the query's label."""
    v = _vectors(spark, sf).withColumnRenamed("model", "label").withColumn("model", F.lit(0))
    near = N.exact(v.filter("id % 50 = 0"), v, 5)
    label = v.select("id", "label")
    hit = near.join(label, "id").join(label.select(F.col("id").alias("query"), F.col("label").alias("own")), "query")
    return hit.agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("purity"))


# ---- graph ---------------------------------------------------------------------------------------------------------


def _edges(spark, sf):
    t = S.transitions(event_positions(spark, sf), MIN_CONTEXT)
    return t.select(F.lit("TRANSITIONS_TO").alias("type"), "context", F.col("from_token").alias("src"), F.col("to_token").alias("dst"), "count", "prob", "support")


def facts(spark, sf):
    e = _edges(spark, sf).filter("context = 'global'")
    return e.select(F.concat_ws(":", F.lit("transition"), "src", "dst").alias("fact_id"), "count", "prob")


def fact_exists(spark, sf):
    wanted = event_positions(spark, sf).select(F.concat_ws(":", F.lit("transition"), "token", F.lit("purchase")).alias("fact_id")).distinct()
    return wanted.join(facts(spark, sf), "fact_id", "left_semi")


def graph_filter(spark, sf):
    e = _edges(spark, sf)
    nodes = e.select(F.col("src").alias("id")).distinct().filter("id <> 'error'")
    return G.graph_filter(nodes, e, ("TRANSITIONS_TO",), 0.2).select("context", "src", "dst", "count")


def neighborhood(spark, sf):
    e = _edges(spark, sf).filter("context = 'global'")
    return G.neighborhood(e, e.select(F.col("src").alias("id")).distinct(), 2, 0.1, 12)


#: Level that steps of bounded paths don't pass.
MAX_LEVEL = 0.8


def k_best_paths(spark, sf, k: int = 5, max_edges: int = 6):
    """Paths without constraint, paths that never step down and paths under a largest level; a token's level is how rare its steps are."""
    e = materialize(_edges(spark, sf).filter("context = 'global'"), "edges")
    ends = e.select("src").distinct()
    pairs = materialize(ends.join(ends.select(F.col("src").alias("dst")), F.col("src") < F.col("dst")), "pairs")
    total = e.agg(F.sum("count")).first()[0]
    levels = materialize(e.groupBy(F.col("src").alias("id")).agg(F.round(1 - F.sum("count") / F.lit(float(total or 1)), 9).alias("level")), "levels")
    found = {"none": G.k_best_paths(e, pairs, k, max_edges, keep=materialize), "rising": G.k_best_paths(e, pairs, k, max_edges, levels, rising=True, keep=materialize), "bounded": G.k_best_paths(e, pairs, k, max_edges, levels, max_level=MAX_LEVEL, keep=materialize)}
    return reduce(DataFrame.unionByName, [d.withColumn("rule", F.lit(rule)) for rule, d in found.items()])


def merge_graphs(spark, sf):
    e = _edges(spark, sf)
    key = ["src", "dst"]
    first, second = (e.filter(F.col("context") == c).select(*key, "context", "count") for c in ("global", "section:verse"))
    return G.merged(first, second, key)


# ---- examples ------------------------------------------------------------------------------------------------------


def transition_examples(spark, sf, top: int = 50):
    """For each of the most frequent pairs: of its first places in corpus order, the ones with an external id first, then by seeded hash."""
    b = S.bigrams(event_positions(spark, sf)).select("from_token", "to_token", "song", "ordinal", "pos", F.when(F.col("song") % 3 != 0, F.col("song")).alias("external"))
    often = b.groupBy("from_token", "to_token").count().orderBy(F.desc("count"), "from_token", "to_token").limit(top)
    b = b.join(F.broadcast(often.drop("count")), ["from_token", "to_token"], "left_semi")  # top rows
    return X.chosen(b, "from_token", "to_token").select("from_token", "to_token", "song", "ordinal", "pos", "rank")


def pattern_examples(spark, sf):
    """Five places of each frequent pattern, chosen as those of transitions."""
    spark = isolated(spark)
    sections = materialize(event_sections(spark, sf), "sections")
    found = materialize(S.frequent_patterns(sections, MIN_SUPPORT), "frequent")
    places = X.pattern_places(sections, found, keep=materialize).withColumn("external", F.when(F.col("song") % 3 != 0, F.col("song")))
    return X.chosen(places, "pattern").select("pattern", "song", "ordinal", "section", "pos", F.col("offset").alias("turned"), "rank")


def song_refs(spark, sf):
    used = transition_examples(spark, sf).select("song").distinct()
    return event_positions(spark, sf).select("song", "genre", "decade").distinct().join(used, "song", "left_semi")


def _example_requests(spark, sf):
    """A request for each pair, section name, genre and decade that follow each other in the test split: what it gives of the three goes by the first place."""
    p = event_positions(spark, sf).withColumn("split", P.assign_split(F.col("song"))).filter("split = 'test'")
    b = S.bigrams(p).groupBy("from_token", "to_token", "genre", "section", "decade").agg(F.min("pos").alias("at"))
    some = lambda c, *kinds: F.when((F.col("at") % 5).isin(*kinds), F.col(c)).alias(c)
    asked = b.select("from_token", "to_token", some("genre", 1, 4), some("section", 2, 4), some("decade", 3), F.lit(3).alias("limit")).distinct()
    return asked.withColumn("req", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("from_token", "to_token", "genre", "section", "decade")]))


def examples_lookup(spark, sf):
    """The three best examples for each request."""
    sections = event_positions(spark, sf).select("song", "ordinal", "section").distinct()
    known = transition_examples(spark, sf).join(song_refs(spark, sf), "song").join(sections, ["song", "ordinal"])
    return X.by_context(_example_requests(spark, sf), materialize(known, "examples"), "from_token", "to_token").select("req", "from_token", "to_token", "song", "ordinal", "pos", "rank", "nth")


def sample_songs(spark, sf):
    s = event_sections(spark, sf)
    chosen = s.select("song").distinct().orderBy(F.md5(F.concat(F.lit("9:"), F.col("song").cast("string")))).limit(5)
    return s.join(chosen, "song", "left_semi").select("song", "ordinal", F.array_join("tokens", " ").alias("tokens"))


# ---- artifacts -----------------------------------------------------------------------------------------------------


def dedupe_sections(spark, sf):
    """Sections of a song with equal tokens are one, at the first place, with how often they come; places are counted anew."""
    s = event_sections(spark, sf).withColumn("body", F.array_join("tokens", " "))
    one = s.groupBy("song", "body").agg(F.min_by("section", "ordinal").alias("section"), F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("repeat_count"))
    return one.select("song", "body", "section", "repeat_count", (F.row_number().over(Window.partitionBy("song").orderBy("first")) - 1).alias("ordinal"))


def ingest_summary(spark, sf):
    one = dedupe_sections(spark, sf).withColumn("split", P.assign_split(F.col("song")))
    return one.agg(F.sum("repeat_count").alias("sections"), F.count(F.lit(1)).alias("kept"), F.countDistinct(F.when(F.col("split") == "test", F.col("song"))).alias("test_songs"), F.countDistinct("song").alias("songs"))


def corpus_text(spark, sf):
    """song, chords: a song's lines in one text with a marker before each section, as corpus files have it."""
    lines = chord_lines(spark, sf)
    body = lines.groupBy("song", "ordinal", "section").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).getField("symbol"), " ").alias("body"))
    marked = F.concat(F.lit("<"), F.col("section"), F.lit("_"), (F.col("ordinal") + 1).cast("string"), F.lit("> "), F.col("body"))
    return body.groupBy("song").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ordinal", marked.alias("t")))).getField("t"), " ").alias("chords"))


def split_markers(texts):
    """song, ordinal, section, chords: cut at <name_n>; what stands before the first marker and empty bodies go; without a marker there is one unnamed section."""
    marks = F.regexp_extract_all("chords", F.lit("<([^>]+)>"), F.lit(1))
    bodies = F.slice(F.split("chords", "<[^>]+>"), 2, 1 << 30)
    name = lambda m: F.lower(F.substring_index(F.trim(m), "_", 1))
    parts = F.when(F.size(marks) == 0, F.array(F.struct(F.lit(None).cast("string").alias("m"), F.col("chords").alias("b")))).otherwise(F.zip_with(marks, bodies, lambda m, b: F.struct(name(m).alias("m"), b.alias("b"))))
    kept = F.filter(F.transform(parts, lambda p: F.struct(p["m"].alias("m"), F.trim(p["b"]).alias("b"))), lambda p: p["b"] != "")
    return texts.select("song", F.posexplode(kept).alias("ordinal", "p")).select("song", "ordinal", F.col("p.m").alias("section"), F.col("p.b").alias("chords"))


def split_section_markers(spark, sf):
    return split_markers(corpus_text(spark, sf))


def scan_corpus_csv(spark, sf):
    """The corpus as CSV and read back by a fixed schema; blank values are null."""
    from ..sources.files import read_corpus_csv

    path = f"{_checkpoint(spark)}/corpus-{abs(hash(sf))}-csv"
    corpus_text(spark, sf).select(F.col("song").cast("string").alias("id"), "chords", F.lit(" ").alias("main_genre"), F.lit("rock").alias("genres"), F.lit(None).cast("string").alias("release_date"), F.lit("1990.0").alias("decade")).write.mode("overwrite").csv(path, header=True, escape='"')
    return read_corpus_csv(spark, path).select("song", "chords", "genre", "release")


def scan_corpus_jsonl(spark, sf):
    from ..sources.files import read_corpus_jsonl

    path = f"{_checkpoint(spark)}/corpus-{abs(hash(sf))}-jsonl"
    t = corpus_text(spark, sf).withColumn("k", F.col("song") % 3)
    t.select(F.col("song").cast("string").alias("song_id"), *[F.when(F.col("k") == i, F.col("chords")).alias(c) for i, c in enumerate(("chords", "progression", "chord_progression"))]).write.mode("overwrite").json(path)
    return read_corpus_jsonl(spark, path).select("song", "chords")


def limit_songs(spark, sf):
    first = chord_lines(spark, sf).select("song").distinct().orderBy("song").limit(25)
    return chord_lines(spark, sf).join(first, "song", "left_semi").select("song", "ordinal", "pos", "symbol")


def tokenize_progression(spark, sf):
    """Split at - , and |; if that gives one part with a space in it, at white space; blanks go."""
    joined = F.col("body")
    t = split_markers(corpus_text(spark, sf)).select("song", "ordinal", F.when(F.col("song") % 2 == 0, F.translate("chords", " ", "-")).otherwise(F.col("chords")).alias("body"))
    parts = F.split(joined, "[-,|]")
    parts = F.when((F.size(parts) == 1) & F.contains(F.trim(joined), F.lit(" ")), F.split(F.trim(joined), r"\s+")).otherwise(parts)
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return t.select("song", "ordinal", F.size(parts).alias("n"), F.array_join(parts, " ").alias("tokens"))


def content_fingerprint(spark, sf):
    row = F.md5(F.concat_ws("|", "event_id", "user_id", "event_type"))
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("long")).alias("fingerprint"))


def table_size_budget(spark, sf):
    e = table(spark, sf, "events")
    return e.agg((F.count(F.lit(1)) * (F.avg(F.octet_length("event_type")) + F.avg(F.octet_length("props")) + 28) * 1.4 / 1e6).alias("mb"))


_KEY = ["context", "from_token", "to_token", "count"]


def write_artifact(spark, sf):
    """The transitions as a versioned artifact; its manifest."""
    return A.write_artifact(S.transitions(event_positions(spark, sf), MIN_CONTEXT), _checkpoint(spark) + "/artifacts", "transitions", "a", _KEY)


def validate_artifacts(spark, sf):
    """A written artifact against its manifest."""
    told = write_artifact(spark, sf)
    rows = spark.read.parquet(f"{_checkpoint(spark)}/artifacts/transitions/version=a/rows")
    return A.validated(rows, told, [*_KEY, "prob", "pmi", "support"], _KEY, 100.0)


def _attempts(spark, sf):
    t = materialize(S.transitions(event_positions(spark, sf), MIN_CONTEXT), "transitions")
    world = t.filter("context = 'global'")
    given = [(1, "a", world), (2, "a", world), (3, "a", t), (4, "b", t)]
    rows = [A.manifest(d, "transitions", v, _KEY).select(F.lit(i).alias("step"), "version", "rows", "fingerprint") for i, v, d in given]
    versions = world.withColumn("version", F.lit("a")).unionByName(t.withColumn("version", F.lit("b")))
    return versions, A.published(reduce(lambda a, b: a.unionByName(b), rows))


def publish_outcomes(spark, sf):
    """A version, the same again, the same name with other rows, and another version."""
    return _attempts(spark, sf)[1]


def publish_version(spark, sf):
    """Reads see the active version only."""
    return A.read_active(*_attempts(spark, sf)).select("version", "context", "from_token", "to_token", "count")


NAMES = (
    request_metrics_24h, usage_by_model, tool_counts, daily_cost, status_census, hourly_counts, stream_hourly_counts, stream_transitions, stream_dedupe, dedupe_within, heavy_hitters, heavy_hitters_sketch, cosine_topk, cosine_topk_index, index_recall, similar_edges, seed_neighbors, pairwise_cosine, l2_normalize, vector_checks,
    embedding_eval, facts, fact_exists, graph_filter, neighborhood, k_best_paths, merge_graphs, transition_examples, pattern_examples, song_refs,
    examples_lookup, sample_songs, dedupe_sections, ingest_summary, split_section_markers, scan_corpus_csv, scan_corpus_jsonl, limit_songs, tokenize_progression, content_fingerprint, table_size_budget, write_artifact, validate_artifacts,
    publish_outcomes, publish_version,
)
QUERIES = {f.__name__: f for f in NAMES}

TRANS = (EVENT_SQL, CONTEXT_SQL, PAIR_SQL, TRANSITION_SQL)
GLOBAL = "ed AS (SELECT from_token AS src, to_token AS dst, count, prob, support FROM trans WHERE context = 'global')"
VEC = "nv AS (SELECT vec_id AS id, label AS model, [x / sqrt(list_sum([y * y FOR y IN d])) FOR x IN d] AS v FROM (SELECT *, [CAST(z AS DOUBLE) FOR z IN embedding] AS d FROM embeddings))"
COS = "round(list_sum([q.v[i] * n.v[i] FOR i IN range(1, len(q.v) + 1)]), 9)"
TOP = lambda where, k, model="q.model = n.model": f"tk AS (SELECT * FROM (SELECT query, id, cosine, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank FROM (SELECT q.id AS query, n.id AS id, {COS} AS cosine FROM nv q JOIN nv n ON {model} AND q.id <> n.id WHERE {where})) WHERE rank <= {k})"
EX = """
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_token, to_token ORDER BY song % 3 = 0, md5('5:' || from_token || ':' || to_token || ':' || song || ':' || ordinal || ':' || pos)) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY from_token, to_token ORDER BY song, ordinal, pos) AS o FROM (
    SELECT * FROM (SELECT song, ordinal, pos, token AS from_token, lead(token) OVER (PARTITION BY song, ordinal ORDER BY pos) AS to_token FROM seq) WHERE to_token IS NOT NULL)) WHERE o <= 20) WHERE rank <= 5)"""
SONG = "sg AS (SELECT DISTINCT song, genre, decade FROM seq)"
SECS = "sc AS (SELECT song, ordinal, section, string_agg(token, ' ' ORDER BY pos) AS body FROM seq GROUP BY ALL)"
DEDUP = "dd AS (SELECT song, body, min_by(section, ordinal) AS section, count(*) AS repeat_count, min(ordinal) AS f FROM sc GROUP BY song, body)"
CBODY = "cb AS (SELECT song, ordinal, section, string_agg(symbol, ' ' ORDER BY pos) AS body FROM lines GROUP BY ALL)"
CTEXT = "ct AS (SELECT song, string_agg('<' || section || '_' || (ordinal + 1) || '> ' || body, ' ' ORDER BY ordinal) AS chords FROM cb GROUP BY song)"
GRAPH_EDGES = """
ge AS (SELECT 'TRANSITIONS_TO' AS type, context, from_token AS src, to_token AS dst, count FROM trans WHERE context = 'global' OR count >= 5
  UNION ALL SELECT 'PATTERN_CONTAINS', 'global', pattern, token, max(support) FROM (SELECT pattern, support, unnest(string_split(pattern, ' ')) AS token FROM pats) GROUP BY pattern, token)"""

MANIFEST = lambda rel, name: f"{name} AS (SELECT count(*) AS rows, CAST(coalesce(sum(CAST('0x' || substr(md5(context || '|' || from_token || '|' || to_token || '|' || count), 1, 8) AS BIGINT)), 0) AS BIGINT) AS fingerprint FROM {rel})"

ORACLE = {
    "request_metrics_24h": "SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 24 HOURS FROM events)",
    "usage_by_model": """SELECT CASE WHEN k % 10 <> 0 THEN 'm' || (k % 3) ELSE 'flat-' || event_type END AS model, count(*) AS calls, CAST(sum(CASE WHEN k % 10 <> 0 THEN CAST('0.00' || k AS DECIMAL(12, 8)) ELSE 0.01 END) AS DOUBLE) AS cost,
  CAST(sum(CASE WHEN k % 10 <> 0 THEN k ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN k % 10 <> 0 THEN 0 ELSE 1 END) AS BIGINT) AS fell_back FROM (SELECT event_type, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events) GROUP BY 1""",
    "tool_counts": "SELECT tool, count(*) AS n FROM (SELECT event_type AS tool FROM events UNION ALL SELECT 'search' FROM events WHERE value > 50 UNION ALL SELECT 'lookup' FROM events WHERE user_id % 2 = 0) GROUP BY tool",
    "daily_cost": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(value), 4) AS cost, count(*) AS n FROM events GROUP BY 1",
    "status_census": "SELECT CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS slow FROM events GROUP BY ALL",
    "hourly_counts": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, count(*) > 4 AS over_limit, CAST(epoch(date_trunc('hour', max(ts)) + INTERVAL 1 HOUR) - floor(epoch(max(ts))) AS BIGINT) AS seconds_left FROM events GROUP BY 1, 2",
    "stream_transitions": "SELECT from_token, to_token, count(*) AS count FROM (SELECT event_type AS from_token, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_token FROM events) WHERE to_token IS NOT NULL GROUP BY ALL",
    "stream_hourly_counts": """SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, count(*) > 4 AS over_limit, CAST(epoch(date_trunc('hour', max(ts)) + INTERVAL 1 HOUR) - floor(epoch(max(ts))) AS BIGINT) AS seconds_left
  FROM (SELECT *, 4 * (floor(epoch(ts)) - min(floor(epoch(ts))) OVER ()) / greatest(max(floor(epoch(ts))) OVER () - min(floor(epoch(ts))) OVER (), 1) AS part FROM events) WHERE NOT (event_id % 50 = 0 AND part < 1) GROUP BY 1, 2""",
    "dedupe_within": """WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, date_trunc('second', ts) AS ts FROM events),
kept AS (SELECT key, min(ts) AS ts FROM e GROUP BY key UNION ALL SELECT key, ts FROM (SELECT k.key, e.ts, row_number() OVER (PARTITION BY k.key ORDER BY e.ts) AS r FROM kept k JOIN e ON e.key = k.key AND e.ts >= k.ts + INTERVAL 7 DAYS) WHERE r = 1)
SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM kept""",
    "heavy_hitters": sql(EVENT_SQL, CONTEXT_SQL, KEPT_SQL, PATTERN_SQL, "SELECT pattern, support AS n FROM pats"),
    "cosine_topk": sql(VEC, TOP("q.id % 50 = 0", 10), "SELECT * FROM tk"),
    "similar_edges": sql(VEC, TOP("true", 10), "SELECT query AS src, id AS dst, cosine AS weight FROM tk"),
    "seed_neighbors": sql(VEC, TOP("q.id % 50 = 0", 10), "SELECT id, max(cosine) AS similarity FROM tk GROUP BY id ORDER BY similarity DESC, id LIMIT 50"),
    "pairwise_cosine": sql(VEC, f"SELECT q.id AS query, n.id, {COS} AS cosine FROM nv q JOIN nv n ON q.model = n.model WHERE q.id % 50 = 0"),
    "l2_normalize": sql(VEC, "SELECT id, round(list_sum(v), 6) AS total, round(list_sum([x * x FOR x IN v]), 6) AS norm FROM nv"),
    "vector_checks": "SELECT label AS model, count(*) AS n, 0 AS not_finite, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, count(*) FILTER (WHERE sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) NOT BETWEEN 0.99 AND 1.01) AS not_unit FROM embeddings GROUP BY 1",
    "embedding_eval": sql(VEC, TOP("q.id % 50 = 0", 5, "true"), "SELECT avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS purity FROM tk JOIN embeddings a ON a.vec_id = tk.query JOIN embeddings b ON b.vec_id = tk.id"),
    "facts": sql(*TRANS, "SELECT 'transition:' || from_token || ':' || to_token AS fact_id, count, prob FROM trans WHERE context = 'global'"),
    "fact_exists": sql(*TRANS, "SELECT DISTINCT 'transition:' || token || ':purchase' AS fact_id FROM seq WHERE token IN (SELECT from_token FROM trans WHERE context = 'global' AND to_token = 'purchase')"),
    "graph_filter": sql(*TRANS, "SELECT context, from_token AS src, to_token AS dst, count FROM trans WHERE prob >= 0.2 AND from_token <> 'error' AND to_token <> 'error'"),
    "neighborhood": sql(*TRANS, GLOBAL, "e AS (SELECT * FROM ed WHERE prob >= 0.1)", "h1 AS (SELECT src AS seed, 1 AS hop, src, dst, prob FROM e)", "f1 AS (SELECT DISTINCT seed, dst AS node FROM h1 WHERE dst <> seed)", "h2 AS (SELECT f1.seed, 2 AS hop, e.src, e.dst, e.prob FROM f1 JOIN e ON e.src = f1.node)",
        "SELECT seed, hop, src, dst, prob FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY prob DESC, hop, src, dst) AS r FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)) WHERE r <= 12"),
    "k_best_paths": "WITH RECURSIVE " + sql(*TRANS, GLOBAL, "pr AS (SELECT DISTINCT a.src AS s, b.src AS d FROM ed a JOIN ed b ON a.src < b.src)",
        "lvl AS (SELECT src AS id, round(1 - sum(count) / CAST((SELECT sum(count) FROM ed) AS DOUBLE), 9) AS level FROM ed GROUP BY src)",
        "edl AS (SELECT ed.*, coalesce(a.level, 0) AS low, coalesce(b.level, 0) AS high FROM ed LEFT JOIN lvl a ON a.id = src LEFT JOIN lvl b ON b.id = dst)",
        f"""walk AS (SELECT rule, s, d, [s] AS path, CAST(0 AS DOUBLE) AS cost FROM pr, (SELECT unnest(['none', 'rising', 'bounded']) AS rule) UNION ALL SELECT rule, s, d, list_append(path, dst), cost - ln(prob) FROM walk JOIN edl ON edl.src = path[len(path)]
  WHERE len(path) <= 6 AND path[len(path)] <> d AND NOT list_contains(path, dst) AND (rule <> 'rising' OR low <= high) AND (rule <> 'bounded' OR high <= {MAX_LEVEL}))""",
        "SELECT * FROM (SELECT rule, s AS src, d AS dst, row_number() OVER (PARTITION BY rule, s, d ORDER BY round(cost, 9), array_to_string(path, ' ')) AS rank, array_to_string(path, ' ') AS path, round(cost, 9) AS cost FROM walk WHERE path[len(path)] = d) WHERE rank <= 5")[5:],
    "merge_graphs": sql(*TRANS, "SELECT src, dst, context, count FROM (SELECT from_token AS src, to_token AS dst, context, count, row_number() OVER (PARTITION BY from_token, to_token ORDER BY context DESC) AS r FROM trans WHERE context IN ('global', 'section:verse')) WHERE r = 1"),
    "transition_examples": sql(EVENT_SQL, EX, "SELECT from_token, to_token, song, ordinal, pos, rank FROM ex"),
    "song_refs": sql(EVENT_SQL, EX, SONG, "SELECT * FROM sg WHERE song IN (SELECT song FROM ex)"),
    "pattern_examples": sql(EVENT_SQL, CONTEXT_SQL, KEPT_SQL, PATTERN_SQL,
        """plc AS (SELECT t.song, t.ordinal, q.section, t.pos, t.k, array_to_string(t.best.r, ' ') AS pattern FROM (SELECT *, best.k AS k, i - 1 AS pos FROM (SELECT *, list_sort([{'r': list_concat(w[z + 1:], w[1:z]), 'k': z} FOR z IN range(0, length)])[1] AS best FROM (
  SELECT song, ordinal, n AS length, i, toks[i:i + n - 1] AS w FROM (SELECT *, unnest(range(1, len(toks) - n + 2)) AS i FROM secs, (SELECT unnest([3, 4, 5, 6, 7, 8]) AS n))))) t JOIN (SELECT DISTINCT song, ordinal, section FROM seq) q USING (song, ordinal))""",
        "erl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY song, ordinal, pos) AS o FROM plc WHERE pattern IN (SELECT pattern FROM pats)) WHERE o <= 20)",
        "SELECT pattern, song, ordinal, section, pos, k AS turned, rank FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY song % 3 = 0, md5('5:' || pattern || ':' || song || ':' || ordinal || ':' || pos)) AS rank FROM erl) WHERE rank <= 5"),
    "heavy_hitters_sketch": sql(EVENT_SQL, CONTEXT_SQL, KEPT_SQL, PATTERN_SQL, f"SELECT count(*) AS frequent, 0 AS missed, 0 AS outside FROM (SELECT w FROM wins GROUP BY w HAVING count(*) >= {MIN_SUPPORT})"),
    "examples_lookup": sql(EVENT_SQL.replace("seq AS (", "seq0 AS ("), SPLIT_SQL, "seq AS (SELECT * FROM seq0)", EX, SONG,
        "tb AS (SELECT from_token, to_token, genre, section, decade, min(pos) % 5 AS z FROM (SELECT token AS from_token, lead(token) OVER (PARTITION BY song, ordinal ORDER BY pos) AS to_token, genre, section, decade, pos FROM seq0 JOIN spl USING (song) WHERE split = 'test') WHERE to_token IS NOT NULL GROUP BY ALL)",
        "ask AS (SELECT DISTINCT from_token, to_token, CASE WHEN z IN (1, 4) THEN genre END AS genre, CASE WHEN z IN (2, 4) THEN section END AS section, CASE WHEN z = 3 THEN decade END AS decade FROM tb)",
        "fnd AS (SELECT concat_ws('|', a.from_token, a.to_token, coalesce(a.genre, ''), coalesce(a.section, ''), coalesce(a.decade, '')) AS req, e.from_token, e.to_token, e.song, e.ordinal, e.pos, e.rank FROM ask a JOIN (SELECT ex.*, sg.genre, sg.decade, s.section FROM ex JOIN sg USING (song) JOIN (SELECT DISTINCT song, ordinal, section FROM seq0) s USING (song, ordinal)) e ON e.from_token = a.from_token AND e.to_token = a.to_token AND (a.genre IS NULL OR a.genre = e.genre) AND (a.section IS NULL OR a.section = e.section) AND (a.decade IS NULL OR a.decade = e.decade))",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY rank, song, ordinal, pos) AS nth FROM fnd) WHERE nth <= 3"),
    "sample_songs": sql(EVENT_SQL, SECS, "SELECT song, ordinal, body AS tokens FROM sc WHERE song IN (SELECT song FROM (SELECT DISTINCT song FROM sc) ORDER BY md5('9:' || song) LIMIT 5)"),
    "dedupe_sections": sql(EVENT_SQL, SECS, DEDUP, "SELECT song, body, section, repeat_count, row_number() OVER (PARTITION BY song ORDER BY f) - 1 AS ordinal FROM dd"),
    "ingest_summary": sql(EVENT_SQL.replace("seq AS (", "seq0 AS ("), "dig AS (SELECT song, [instr('0123456789abcdef', c) - 1 FOR c IN string_split(sha256(CAST(song AS VARCHAR)), '')] AS d FROM (SELECT DISTINCT song FROM seq0))",
        "tst AS (SELECT song FROM dig WHERE d[64] % 4 = 0 AND list_sum(d) % 5 = 0)", "seq AS (SELECT * FROM seq0)", SECS, DEDUP, "SELECT CAST(sum(repeat_count) AS BIGINT) AS sections, count(*) AS kept, count(DISTINCT song) FILTER (WHERE song IN (SELECT song FROM tst)) AS test_songs, count(DISTINCT song) AS songs FROM dd"),
    "split_section_markers": sql(CHORD_SQL, CBODY, "SELECT song, row_number() OVER (PARTITION BY song ORDER BY ordinal) - 1 AS ordinal, section, body AS chords FROM cb"),
    "scan_corpus_csv": sql(CHORD_SQL, CBODY, CTEXT, "SELECT CAST(song AS VARCHAR) AS song, chords, 'rock' AS genre, '1990' AS release FROM ct"),
    "scan_corpus_jsonl": sql(CHORD_SQL, CBODY, CTEXT, "SELECT CAST(song AS VARCHAR) AS song, chords FROM ct"),
    "limit_songs": sql(CHORD_SQL, "SELECT song, ordinal, pos, symbol FROM lines WHERE song IN (SELECT DISTINCT song FROM lines ORDER BY song LIMIT 25)"),
    "tokenize_progression": sql(CHORD_SQL, CBODY, "SELECT song, row_number() OVER (PARTITION BY song ORDER BY ordinal) - 1 AS ordinal, len(string_split(body, ' ')) AS n, body AS tokens FROM cb"),
    "content_fingerprint": "SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(event_id || '|' || user_id || '|' || event_type), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM events",
    "table_size_budget": "SELECT count(*) * (avg(strlen(event_type)) + avg(strlen(props)) + 28) * 1.4 / 1e6 AS mb FROM events",
    "write_artifact": sql(*TRANS, MANIFEST("trans", "m"), "SELECT 'transitions' AS name, 'a' AS version, rows, fingerprint, 'context,from_token,to_token,count,prob,pmi,support' AS columns FROM m"),
    "validate_artifacts": sql(*TRANS, MANIFEST("trans", "m"), """SELECT 'columns' AS name, 7.0 AS wanted, 7.0 AS found, true AS ok UNION ALL SELECT 'rows', rows, rows, true FROM m UNION ALL SELECT 'fingerprint', fingerprint, fingerprint, true FROM m
  UNION ALL SELECT 'size', 100.0, round(sum(strlen(context) + strlen(from_token) + strlen(to_token) + strlen(CAST(count AS VARCHAR)) + 56) * 1.4 / 1e6, 6), sum(56) * 1.4 / 1e6 <= 100 FROM trans"""),
    "publish_outcomes": sql(*TRANS, "w AS (SELECT * FROM trans WHERE context = 'global')", MANIFEST("w", "m1"), MANIFEST("trans", "m2"), """SELECT 1 AS step, 'a' AS version, rows, 'published' AS outcome, 'a' AS active, false AS kept FROM m1 UNION ALL SELECT 2, 'a', rows, 'unchanged', 'a', false FROM m1
  UNION ALL SELECT 3, 'a', m2.rows, CASE WHEN m1.rows = m2.rows AND m1.fingerprint = m2.fingerprint THEN 'unchanged' ELSE 'refused' END, 'a', false FROM m1, m2 UNION ALL SELECT 4, 'b', rows, 'published', 'b', true FROM m2"""),
    "publish_version": sql(*TRANS, "SELECT 'b' AS version, context, from_token, to_token, count FROM trans"),
}
ORACLE["stream_dedupe"] = ORACLE["dedupe_within"]
