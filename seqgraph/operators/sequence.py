"""Aggregates over token sequences: contexts, transitions, n-grams with continuation counts, patterns.

Positions are rows (song, ordinal, section, genre, decade, pos, token); a section is (song, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = ("song", "ordinal")
DIMENSIONS = ("genre", "section", "decade")
MAX_ORDER_GLOBAL, MAX_ORDER_OTHER = 5, 3


def context_keys() -> Column:
    """global, genre, section, decade and genre x section of a row; a null or empty dimension gives none."""
    dim = lambda c: F.nullif(F.col(c), F.lit(""))
    key = lambda name, *cols: F.concat(F.lit(f"{name}:"), *[x for i, c in enumerate(cols) for x in ([F.lit(":")] if i else []) + [dim(c)]])
    return F.array_compact(F.array(F.lit("global"), key("genre", "genre"), key("section", "section"), key("decade", "decade"), key("genre_section", "genre", "section")))


def explode_contexts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("context", F.explode(context_keys()))


def kept_contexts(positions: DataFrame, min_bigrams: int) -> DataFrame:
    """context, bigrams: global, and contexts with min_bigrams adjacent pairs or more."""
    sizes = positions.groupBy(*SECTION, *DIMENSIONS).agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("n"))
    total = explode_contexts(sizes).groupBy("context").agg(F.sum("n").alias("bigrams"))
    return total.filter((F.col("context") == "global") | (F.col("bigrams") >= min_bigrams))


def bigrams(positions: DataFrame) -> DataFrame:
    """Adjacent pairs within a section: from_token, to_token, with the position's other columns."""
    nxt = F.lead("token").over(Window.partitionBy(*SECTION).orderBy("pos"))
    return positions.withColumn("to_token", nxt).filter(F.col("to_token").isNotNull()).withColumnRenamed("token", "from_token")


def transitions(positions: DataFrame, min_transitions: int = 2000) -> DataFrame:
    """context, from_token, to_token, count, prob, pmi, support (distinct songs).

    Pairs are first counted by song, before contexts multiply them; so a context that every row has (global) is
    aggregated from small partial rows, and support is a count of rows.
    """
    by_song = bigrams(positions).groupBy("song", *DIMENSIONS, "from_token", "to_token").agg(F.count(F.lit(1)).alias("n"))
    by_song = explode_contexts(by_song).groupBy("context", "from_token", "to_token", "song").agg(F.sum("n").alias("n"))
    pair = by_song.groupBy("context", "from_token", "to_token").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("support"))
    # totals are sums by key, which combine before the shuffle; no task holds all pairs of a context
    total = lambda name, *c: pair.groupBy("context", *c).agg(F.sum("count").alias(name))
    size = total("total").filter((F.col("context") == "global") | (F.col("total") >= min_transitions))
    pair = pair.join(size, "context").join(total("out", "from_token"), ["context", "from_token"]).join(total("in", "to_token"), ["context", "to_token"])
    pmi = F.log(F.col("count") * F.col("total") / (F.col("out").cast("double") * F.col("in")))
    return pair.select("context", "from_token", "to_token", "count", (F.col("count") / F.col("out")).alias("prob"), pmi.alias("pmi"), "support")


def grouped_transitions(positions: DataFrame, dimension_sets: tuple[tuple[str, ...], ...] = ((), ("genre",), ("section",), ("decade",), ("genre", "section"))) -> DataFrame:
    """from_token, to_token, genre, section, decade, count, probability by grouping sets; a null dimension means all, rows without it don't count."""
    counted = bigrams(positions).groupBy(*DIMENSIONS, "from_token", "to_token").agg(F.count(F.lit(1)).alias("n"))
    sets = [[F.col(c) for c in ("from_token", "to_token", *some)] for some in dimension_sets]
    marks = {c: F.grouping(c) for c in DIMENSIONS}
    out = counted.groupingSets(sets, "from_token", "to_token", *DIMENSIONS).agg(F.sum("n").alias("count"), *[m.alias(f"g_{c}") for c, m in marks.items()])
    for c in DIMENSIONS:
        out = out.filter((F.col(f"g_{c}") == 1) | F.col(c).isNotNull())
    bucket = Window.partitionBy("from_token", *DIMENSIONS, *[f"g_{c}" for c in DIMENSIONS])
    return out.select("from_token", "to_token", *DIMENSIONS, "count", (F.col("count") / F.sum("count").over(bucket)).alias("probability"))


def max_order(context: Column) -> Column:
    return F.when(context == "global", MAX_ORDER_GLOBAL).otherwise(MAX_ORDER_OTHER)


def ngram_counts(positions: DataFrame, contexts: DataFrame, prune: dict[int, int] | None = None) -> DataFrame:
    """context, order, history (joined by a space), token, cnt, cont, total, distinct_next.

    cont counts the distinct one-longer histories, before pruning, that end in this history and precede the token.
    Histories of an order whose total is below prune[order] are left out.
    """
    prune = {3: 30, 4: 48, 5: 75} if prune is None else prune
    back = Window.partitionBy(*SECTION).orderBy("pos")
    rows = positions.select(*SECTION, *DIMENSIONS, "pos", "token", *[F.lag("token", k).over(back).alias(f"h{k}") for k in range(1, MAX_ORDER_GLOBAL)])
    history = lambda order: F.concat_ws(" ", *[F.col(f"h{k}") for k in range(order - 1, 0, -1)]) if order > 1 else F.lit("")
    orders = F.array(*[F.when(F.col("pos") >= o - 1, F.struct(F.lit(o).alias("order"), history(o).alias("history"))) for o in range(1, MAX_ORDER_GLOBAL + 1)])
    each = rows.select(*DIMENSIONS, "token", F.explode(F.array_compact(orders)).alias("x")).select(*DIMENSIONS, "token", "x.*")
    counted = each.groupBy(*DIMENSIONS, "order", "history", "token").agg(F.count(F.lit(1)).alias("cnt"))
    counted = explode_contexts(counted).filter(F.col("order") <= max_order(F.col("context"))).join(contexts.select("context"), "context", "left_semi")
    counted = counted.groupBy("context", "order", "history", "token").agg(F.sum("cnt").alias("cnt"))
    shorter = F.when(F.instr("history", " ") > 0, F.expr("substring(history, instr(history, ' ') + 1)")).otherwise("")
    cont = counted.filter("order > 1").groupBy("context", (F.col("order") - 1).alias("order"), shorter.alias("history"), "token").agg(F.count(F.lit(1)).alias("cont"))
    of = Window.partitionBy("context", "order", "history")
    full = counted.join(cont, ["context", "order", "history", "token"], "left").fillna(0, ["cont"])
    full = full.withColumns({"total": F.sum("cnt").over(of), "distinct_next": F.count(F.lit(1)).over(of)})
    least = F.coalesce(*[F.when(F.col("order") == o, n) for o, n in prune.items()], F.lit(0)) if prune else F.lit(0)
    return full.filter(F.col("total") >= least)


def discount_stats(ngrams: DataFrame) -> DataFrame:
    """context, order, n1, n2: how many (history, token) were seen once and twice."""
    return ngrams.groupBy("context", "order").agg(F.count_if(F.col("cnt") == 1).alias("n1"), F.count_if(F.col("cnt") == 2).alias("n2"))


def cut_windows(sections: DataFrame, lengths: tuple[int, int] = (3, 8)) -> DataFrame:
    """song, dimensions, w (the tokens, joined by a space), length: a row for each place."""
    lo, hi = lengths
    starts = lambda n: F.sequence(F.lit(1), F.size("tokens") - n + 1)
    cut = lambda n: F.when(F.size("tokens") >= n, F.transform(starts(n), lambda i: F.struct(F.lit(n).cast("long").alias("length"), F.array_join(F.slice("tokens", i, n), " ").alias("w"))))
    listed = F.flatten(F.array_compact(F.array(*[cut(n) for n in range(lo, hi + 1)])))
    return sections.select("song", *DIMENSIONS, F.explode(listed).alias("x")).select("song", *DIMENSIONS, "x.w", "x.length")


def windows(sections: DataFrame, lengths: tuple[int, int] = (3, 8)) -> DataFrame:
    """song, dimensions, w, length, n: how often a song has each window, of every length, under each choice of dimensions."""
    return cut_windows(sections, lengths).groupBy("song", *DIMENSIONS, "w", "length").agg(F.count(F.lit(1)).alias("n"))


def smallest_rotation(w: Column) -> Column:
    """(pattern, offset): the smallest rotation of a window, joined by a space, and by how many tokens it is turned."""
    t, size = F.split(w, " "), F.size(F.split(w, " "))
    turns = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.struct(F.concat(F.slice(t, k + 1, size), F.slice(t, F.lit(1), k)).alias("r"), k.alias("k")))
    best = F.array_min(turns)
    return F.struct(F.array_join(best["r"], " ").alias("pattern"), best["k"].cast("long").alias("offset"))


def frequent_patterns(sections: DataFrame, min_support: int, lengths: tuple[int, int] = (3, 8)) -> DataFrame:
    """pattern, support of the frequent patterns alone: as patterns(), but windows are counted together, not by song and context, and nothing is stored."""
    once = cut_windows(sections, lengths).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    turned = once.select(smallest_rotation(F.col("w"))["pattern"].alias("pattern"), "n")
    return turned.groupBy("pattern").agg(F.sum("n").alias("support")).filter(F.col("support") >= min_support)


def patterns(sections: DataFrame, min_support: int, min_context: int, song_cap: int = 2000, lengths: tuple[int, int] = (3, 8), keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """Frequent patterns (pattern, length, support, song_count, rotations), and lifts (pattern, context, lift).

    Windows are counted by song first, and only distinct ones are rotated. Supports are counted from their totals; the rest is worked
    out for frequent patterns only. Lift is the pattern's share of a context's windows over its share of all; kept contexts
    with enough windows have a lift for every pattern, 0 too. keep(df, name): stores what several branches read.
    """
    w = keep(windows(sections, lengths), "windows")
    once = w.groupBy("w", "length").agg(F.sum("n").alias("n"))
    turned = keep(once.withColumn("best", smallest_rotation(F.col("w"))).select("w", "length", "n", "best.pattern", "best.offset"), "rotations")
    supports = turned.groupBy("pattern", "length").agg(F.sum("n").alias("support"), F.array_join(F.array_sort(F.collect_set("offset")), ",").alias("rotations"))
    frequent = supports.filter(F.col("support") >= min_support)
    kept = keep(turned.select("w", "pattern").join(frequent, "pattern"), "frequent-windows")
    found = kept.select("pattern", "length", "support", "rotations").distinct()
    by_song = keep(w.join(kept.select("w", "pattern"), "w").groupBy("song", *DIMENSIONS, "pattern").agg(F.sum("n").alias("n")), "pattern-songs")
    songs = by_song.select("pattern", "song").distinct().groupBy("pattern").agg(F.least(F.count(F.lit(1)), F.lit(song_cap)).alias("song_count"))
    pairs = sections.select("song", *DIMENSIONS, F.greatest(F.size("tokens") - 1, F.lit(0)).alias("n"))
    big = explode_contexts(pairs).groupBy("context").agg(F.sum("n").alias("b")).filter((F.col("context") == "global") | (F.col("b") >= min_context)).select("context")
    totals = keep(explode_contexts(w.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))).groupBy("context").agg(F.sum("n").alias("windows")).join(big, "context", "left_semi"), "context-windows")
    by_context = explode_contexts(by_song.groupBy(*DIMENSIONS, "pattern").agg(F.sum("n").alias("n"))).groupBy("context", "pattern").agg(F.sum("n").alias("n"))
    everywhere = totals.filter("context = 'global'").select(F.col("windows").alias("all_windows"))
    # a lift for every frequent pattern and kept context: that is the result's size
    grid = found.select("pattern", "support").join(totals.filter((F.col("context") != "global") & (F.col("windows") >= min_context)))
    grid = grid.join(F.broadcast(everywhere))  # one row
    lift = (F.coalesce("n", F.lit(0)) / F.col("windows")) / (F.col("support") / F.col("all_windows"))
    found = found.join(songs, "pattern").select("pattern", "length", "support", "song_count", "rotations")
    return found, grid.join(by_context, ["context", "pattern"], "left").select("pattern", "context", lift.alias("lift"))
