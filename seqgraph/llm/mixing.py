"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold a text, in whichever of its copies. Token
capacity flows from patterns to source quotas; each further repetition of a pattern's texts costs more (convex), so
repetition is spread evenly and used last, and a text that two sources hold is used where it is needed.
Documents are then chosen in a seeded order, each with the odds that the flow from its pattern to its source gives it, until
the source's flow is met. Patterns of several sources, however many, stay in Spark; the driver sees sources and pairs of them.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

#: Documents in a bucket of the selection's histogram, about.
BUCKET_DOCS = 4096
#: Documents of each size class offered for what larger classes leave over: eight hold at least twice what the next larger class can leave.
SPARES = 8
#: Steps that a seeded hash and a share are told in.
STEPS = 40
#: Height of a source from which no need can be reached.
FAR = 1_000_000


def capped_targets(sizes: list[float], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of all tokens by weight; a target stops at cap times its source, the excess is shared anew by weight."""
    open_, targets = set(range(len(sizes))), [0.0] * len(sizes)
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if total and left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total if total else 0.0
            break
        for i in over:
            targets[i] = cap * float(sizes[i])
            open_.discard(i)
        left = max(0.0, float(sum(sizes)) - sum(targets[i] for i in range(len(sizes)) if i not in open_))
    return targets


def min_cost_flow(distinct: list[float], members: list[dict[int, float]], quotas: list[float], repeats: int = 3) -> list[dict[int, float]]:
    """Words that each pattern gives to each of its sources, for patterns held in one place; pattern_flow() is the same for a table of them.

    distinct: words of each pattern's different texts; members: the words that a pattern's documents have in each of its
    sources (infinite where a document can be counted in any of them).
    Network: start -> pattern (arcs of the distinct words, the r-th use of cost r, up to `repeats`; an arc for all further use,
    of cost `repeats`), pattern -> source (`repeats` times its words there), source -> end (the quota). Successive cheapest
    paths with potentials; the number of nodes is patterns + sources, whatever the number of documents.
    """
    n_p, n_s = len(distinct), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: float, cost: float) -> list:
        there, back = [b, room, cost, None], [a, 0.0, -cost, None]
        there[3], back[3] = back, there
        graph[a].append(there)
        graph[b].append(back)
        return there

    for p in range(n_p):
        for r in range(repeats):
            arc(start, p, float(distinct[p]), float(r))
        if (further := repeats * (sum(members[p].values()) - distinct[p])) < math.inf:
            arc(start, p, max(0.0, further), float(repeats))
    out = [{s: arc(p, n_p + s, repeats * float(w), 0.0) for s, w in members[p].items()} for p in range(n_p)]
    for s in range(n_s):
        arc(n_p + s, end, float(quotas[s]), 0.0)
    scale = 1e-9 * (sum(distinct) + 1)
    potential = [0.0] * (end + 1)
    while True:
        dist, via, heap = [math.inf] * (end + 1), [None] * (end + 1), [(0.0, start)]
        dist[start] = 0.0
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for a in graph[v]:
                if a[1] > scale and (to := d + a[2] + potential[v] - potential[a[0]]) < dist[a[0]] - 1e-12:
                    dist[a[0]], via[a[0]] = to, a
                    heapq.heappush(heap, (to, a[0]))
        if via[end] is None:
            return [{s: a[3][1] for s, a in arcs.items()} for arcs in out]
        potential = [p + min(d, dist[end]) for p, d in zip(potential, dist, strict=True)]
        push, v = math.inf, end
        while v != start:
            push = min(push, via[v][1])
            v = via[v][3][0]
        v = end
        while v != start:
            via[v][1] -= push
            via[v][3][1] += push
            v = via[v][3][0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _source_weights(sources: list[str | None], cycle: tuple[float, ...]) -> list[float]:
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, (sources[i] or "").encode("utf-32-be")))
    weights = [0.0] * len(sources)
    for rank, i in enumerate(order):
        weights[i] = cycle[rank % len(cycle)]
    return weights


def own_sources(docs: DataFrame, source_col: str) -> Column:
    """The sources that a row counts in, as an array; the null source where there is none."""
    if not isinstance(docs.schema[source_col].dataType, T.ArrayType):
        return F.array(F.col(source_col).cast("string"))
    distinct = F.array_sort(F.array_distinct(F.col(source_col).cast("array<string>")))
    return F.when(F.size(distinct) > 0, distinct).otherwise(F.array(F.lit(None).cast("string")))


def sized_documents(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", patterns: int | None = None) -> DataFrame:
    """doc_id, pattern (the sources that hold a row's text), own (those it counts in), pool (both, as JSON), size in words, body (a hash of the text).

    Where source_col is an array, a row counts in any of its sources, and they are its pattern. Else it counts in its one source, and its
    pattern has the sources of all rows with equal text; texts without words are in their own source's. A caller who wants no more than
    `patterns` patterns of several sources gets those with the most words; other rows are then in the pattern of their own source.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), own_sources(docs, source_col).alias("own"), word_count(F.col(text_col)).alias("size"), text_hash(F.col(text_col)).alias("body"))
    if isinstance(docs.schema[source_col].dataType, T.ArrayType):
        d = d.withColumn("pattern", F.col("own"))
    else:
        d = stored(d, "documents-by-size")
        held = d.filter("size > 0").groupBy("body").agg(F.collect_set("own").alias("held"), F.sum("size").alias("words")).filter(F.size("held") > 1)
        held = stored(held.select(F.col("body").alias("same"), F.flatten(F.array_sort("held")).alias("several"), "words"), "shared-texts")
        if patterns is not None:
            most = held.groupBy("several").agg(F.sum("words").alias("words")).orderBy(F.desc("words"), "several").limit(patterns).select(F.col("several").alias("kept"))
            held = held.join(most, F.col("several") == F.col("kept"), "left_semi")
        d = d.join(held.select("same", "several"), F.col("body") == F.col("same"), "left").withColumn("pattern", F.coalesce("several", "own"))
    return d.select("doc_id", "pattern", "own", F.to_json(F.struct("pattern", "own")).alias("pool"), "size", "body")


def _widest(rooms: dict[tuple[int, int], float], start: int, end: int) -> tuple[float, list[tuple[int, int]]]:
    """The path on which most can be moved at once, and how much; 0 if there is none."""
    out: dict[int, list[tuple[int, float]]] = {}
    for (a, b), room in rooms.items():
        out.setdefault(a, []).append((b, room))
    best, via, heap = {start: math.inf}, {}, [(-math.inf, start)]
    while heap:
        w, v = heapq.heappop(heap)
        if v == end:
            path = []
            while v != start:
                path.append((via[v], v))
                v = via[v]
            return -w, path[::-1]
        if -w < best[v]:
            continue
        for b, room in out.get(v, ()):
            if (to := min(-w, room)) > best.get(b, 0.0):
                best[b], via[b] = to, v
                heapq.heappush(heap, (-to, b))
    return 0.0, []


def _max_flow(rooms: dict[tuple[int, int], float], start: int, end: int, least: float) -> dict[tuple[int, int], float]:
    """What the greatest flow moves on each arc, by widest paths, up to paths of `least`."""
    left = dict(rooms)
    while (found := _widest(left, start, end))[0] > least:
        for a, b in found[1]:
            left[a, b] -= found[0]
            left[b, a] = left.get((b, a), 0.0) + found[0]
    return {arc: room - left[arc] for arc, room in rooms.items() if room > left[arc]}


def _hops(arcs: list[tuple[int, int]], ends: list[int]) -> dict[int, int]:
    """Steps on the arcs from each node to the nearest of ends."""
    into: dict[int, list[int]] = {}
    for a, b in arcs:
        into.setdefault(b, []).append(a)
    far, todo = dict.fromkeys(ends, 0), list(ends)
    for b in todo:
        for a in into.get(b, ()):
            if a not in far:
                far[a] = far[b] + 1
                todo.append(a)
    return far


def _open_moves(state: DataFrame, level: int, repeats: int, heights: list[int] | None) -> tuple[DataFrame, Column]:
    """state with `ends`, what each source of a pattern can give and take (the first, -1, is the pattern's spare words, uses up to the
    level-th), and the column function of what can move from one end to another.

    Without heights: for each pair of ends alone. With heights: for all pairs at once, to those ends of a pattern that are lowest, from its
    spare words and the ends one higher, each taking and giving in proportion.
    """
    used = F.aggregate("arms", F.lit(0.0), lambda acc, x: acc + x["flow"])
    upto = F.least(F.col("distinct") * level, F.col("top")) if level <= repeats else F.col("top")
    d = state.withColumn("spare", F.greatest(F.lit(0.0), upto - used))
    end = lambda at, give, take: F.struct(at.cast("int").alias("at"), give.alias("give"), take.alias("take"))
    room = lambda x: F.greatest(F.lit(0.0), x["room"] - x["flow"])
    first = F.array(end(F.lit(-1), F.col("spare"), F.lit(0.0)))
    if heights is None:
        d = d.withColumn("ends", F.concat(first, F.transform("arms", lambda x: end(x["at"], x["flow"], room(x)))))
        return d, lambda g, t: F.least(g["give"], t["take"])
    told = state.sparkSession.createDataFrame([(heights,)], "heights array<int>")
    d = d.crossJoin(F.broadcast(told))
    high = lambda x: F.get("heights", x["at"])
    d = d.withColumn("low", F.array_min(F.transform("arms", lambda x: F.when(room(x) > 0, high(x)).otherwise(FAR))))
    give = lambda x: F.when(high(x) == F.col("low") + 1, x["flow"]).otherwise(0.0)
    take = lambda x: F.when((high(x) == F.col("low")) & (F.col("low") < FAR), room(x)).otherwise(0.0)
    d = d.withColumn("ends", F.concat(first, F.transform("arms", lambda x: end(x["at"], give(x), take(x)))))
    total = lambda of: F.aggregate("ends", F.lit(0.0), lambda acc, x: acc + x[of])
    d = d.withColumn("most", F.greatest(total("give"), total("take"), F.lit(1e-300)))
    return d, lambda g, t: g["give"] * (t["take"] / F.col("most"))


def _rooms(state: DataFrame, level: int, repeats: int, heights: list[int] | None = None) -> dict[tuple[int, int], float]:
    """How many words the patterns can move from source to source (-1: from their spare words), a row for each pair. Sums are of decimals, so any order gives the same."""
    d, amount = _open_moves(state, level, repeats, heights)
    pairs = F.flatten(F.transform("ends", lambda g: F.transform("ends", lambda t: F.struct(g["at"].alias("a"), t["at"].alias("b"), amount(g, t).alias("words")))))
    rows = d.select(F.explode(F.filter(pairs, lambda x: (x["words"] > 0) & (x["a"] != x["b"]))).alias("x")).groupBy("x.a", "x.b").agg(F.sum(F.col("x.words").cast("decimal(28,6)")).alias("words"))
    return {(r["a"], r["b"]): float(r["words"]) for r in sorted(rows.collect(), key=lambda r: (r["a"], r["b"])) if r["words"] > 0}


def _moved(state: DataFrame, level: int, repeats: int, heights: list[int] | None, parts: list[float], n: int) -> DataFrame:
    """state after the part of what can move from end a to end b has moved; parts are by (a + 1) * n + b."""
    d, amount = _open_moves(state, level, repeats, heights)
    d = d.crossJoin(F.broadcast(state.sparkSession.createDataFrame([(parts,)], "parts array<double>")))
    part = lambda g, t: F.when((t["at"] >= 0) & (g["at"] != t["at"]), F.get("parts", (g["at"] + 1) * n + t["at"]) * amount(g, t)).otherwise(0.0)
    came = lambda x: F.aggregate("ends", F.lit(0.0), lambda acc, g: acc + part(g, x))
    went = lambda x: F.aggregate("ends", F.lit(0.0), lambda acc, t: acc + part(x, t))
    flows = F.transform(F.slice("ends", 2, F.greatest(F.lit(1), F.size("arms"))), lambda x: came(x) - went(x))
    moved = d.withColumn("change", flows)
    arm = lambda x, c: F.struct(x["at"].alias("at"), x["room"].alias("room"), F.least(x["room"], F.greatest(F.lit(0.0), x["flow"] + c)).alias("flow"))
    return moved.select("key", "distinct", "top", F.zip_with("arms", "change", arm).alias("arms"))


def pattern_flow(state: DataFrame, own: list[tuple[float, float]], quotas: list[float], repeats: int = 3) -> tuple[DataFrame, list[float]]:
    """min_cost_flow() for a table of patterns, in which they stay: state with the flow of each arm, and the words of each source's own texts.

    state: key, distinct, top (most words of a pattern in all), arms (array of at, room, flow; at numbers the quotas), for patterns of
    several sources; own: distinct words and most words of the texts that only one source holds, for each source.
    Uses of a text up to the first cost nothing, those up to the second 1 and so on, so the greatest flow within the first uses comes first; with
    a further use allowed it is made greater, until the quotas are met. In a round, what patterns can move between each pair of sources is
    summed in Spark. If no path leads from spare words to a need, that proves the flow greatest. Else the driver routes words over sources
    and pairs, and each pattern moves its part. Either all pairs move at once, towards the needs by the fewest hops, or what the
    widest path takes, whichever is more; as the widest path has at least a fixed part of what is left, the rounds end.
    """
    n, least = len(quotas), 1e-9 * (sum(quotas) + 1)
    need, used = [float(q) for q in quotas], [0.0] * len(quotas)
    for level in range(1, repeats + 2):
        while sum(need) > least:
            spare = [max(0.0, (min(level * d, most) if level <= repeats else most) - u) for (d, most), u in zip(own, used, strict=True)]

            def arcs(found: dict[tuple[int, int], float], spare: list[float] = spare) -> dict[tuple[int, int], float]:
                out = {arc: room for arc, room in found.items() if room > least}
                for s in range(n):
                    if spare[s] > 0:
                        out[-1, s] = out.get((-1, s), 0.0) + spare[s]
                    if need[s] > 0:
                        out[s, n] = need[s]
                return out

            alone = _rooms(state, level, repeats)
            rooms = arcs(alone)
            width, path = _widest(rooms, -1, n)
            if width <= least:
                break
            reached = _hops([(b, a) for a, b in rooms], [-1])
            far = _hops([(a, b) for a, b in rooms if a >= 0 and b < n and a in reached], [s for s in range(n) if need[s] > 0])
            heights = [far.get(s, FAR + 1) for s in range(n)]
            found = _rooms(state, level, repeats, heights)
            moves = _max_flow(arcs(found), -1, n, least)
            if sum(v for (_, b), v in moves.items() if b == n) < width:
                found, heights, moves = alone, None, dict.fromkeys(path, width)
            parts = [0.0] * ((n + 1) * n)
            for (a, b), words in sorted(moves.items()):
                if b == n:
                    need[a] = max(0.0, need[a] - words)
                    continue
                if a == -1:
                    alone_there = min(words, spare[b])
                    used[b] += alone_there
                    words -= alone_there
                if words > 0:
                    parts[(a + 1) * n + b] = min(1.0, words / found[a, b])
            if any(parts):
                state = stored(_moved(state, level, repeats, heights, parts, n), "mix-flow")
    return state, used


def plan_mix(sized: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3) -> DataFrame:
    """A row for each pool (pattern and own sources): its words, source_size and target of its first own source, flow (words to take of it).

    A row for each source comes to the driver, and in pattern_flow() one for each pair of sources that hold a text; pools and patterns don't.
    """
    spark, key = sized.sparkSession, F.to_json("pattern").alias("key")
    pools = stored(sized.groupBy("pool", "pattern", "own").agg(F.sum("size").alias("words")).select("pool", key, "own", (F.size("pattern") == 1).alias("single"), "words"), "mix-pools")
    once = sized.groupBy("pattern", "body").agg(F.max("size").alias("size")).groupBy("pattern").agg(F.sum("size").cast("double").alias("distinct"))
    once = stored(once.select(key, "distinct", F.when(F.size("pattern") == 1, F.struct(F.col("pattern")[0].alias("name"))).alias("single")), "mix-patterns")
    totals = {r["x"]: r["words"] for r in pools.select(F.explode("own").alias("x"), "words").groupBy("x").agg(F.sum("words").alias("words")).collect()}
    names = sorted(totals, key=lambda x: (x is None, (x or "").encode("utf-32-be")))
    sizes = [totals[x] for x in names]
    targets = capped_targets(sizes, _source_weights(names, cycle), cap)
    words = {r["own"][0]: float(r["words"]) for r in pools.filter("single").collect()}
    distinct = {r["single"]["name"]: r["distinct"] for r in once.filter("single IS NOT NULL").collect()}
    places = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, at int")
    arms = pools.filter("NOT single").join(once.select("key", "distinct"), "key").select("key", "distinct", F.when(F.size("own") > 1, cap * F.col("distinct")).otherwise(cap * F.col("words")).cast("double").alias("room"), (F.size("own") > 1).alias("any"), F.explode("own").alias("x"))
    arms = arms.join(F.broadcast(places), F.col("x").eqNullSafe(F.col("name")))
    arm = F.struct("at", "room", F.lit(0.0).alias("flow"))
    # a pattern's rooms are whole numbers of words: their sum is the same in any order
    state = arms.groupBy("key").agg(F.first("distinct").alias("distinct"), F.when(F.max("any"), cap * F.first("distinct")).otherwise(F.sum("room")).alias("top"), F.array_sort(F.collect_list(arm)).alias("arms"))
    own = [(distinct.get(x, 0.0), cap * words.get(x, 0.0)) for x in names]
    state, used = pattern_flow(stored(state, "mix-flow"), own, targets, cap)
    known = spark.createDataFrame([(x, i, *r) for i, (x, *r) in enumerate(zip(names, sizes, targets, used, strict=True))], "name string, at int, source_size long, target double, used double")
    out = pools.join(F.broadcast(known), F.col("own")[0].eqNullSafe(F.col("name")))
    alone = out.filter("single").withColumn("flow", F.col("used"))
    mine = F.filter("arms", lambda x: (F.size("own") > 1) | (x["at"] == F.col("at")))
    several = out.filter("NOT single").join(state.select("key", "arms"), "key").withColumn("flow", F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + x["flow"]))
    columns = ["pool", "single", "words", "source_size", "target", "flow"]
    return alone.select(columns).unionByName(several.select(columns))


def select_documents(sized: DataFrame, plan: DataFrame, seed: int = 7, cap: int = 3) -> DataFrame:
    """sized with source_size, target and copies: how often the mix takes each document.

    flow / words gives every document of a pool so many whole copies, and a share of one more. Documents of a source (of all its
    pools) get one more in the order of a seeded hash less the share, within each size class, as far as the class's shares go; so each gets
    it with the odds of its share, but for where the order ends. There, documents of the source alone come in without a share. What the classes
    leave over (less than a document each) goes to the next few documents, larger classes first.
    Rows with equal id and text are treated alike, so reruns agree. A histogram of the order by source and class
    finds where the shares end; only documents in that one bucket are ordered, so no window spans a source, and
    all that is joined to the documents is a few rows for each source and class, and for texts of several sources a row for each pool.
    """
    ratio = F.when(F.col("words") > 0, F.least(F.col("flow") / F.col("words"), F.lit(float(cap)))).otherwise(0.0)
    known = plan.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("share", F.when(ratio - F.col("whole") > 1e-9, ratio - F.col("whole")).otherwise(0.0))
    known = known.select("pool", "single", "source_size", "target", "whole", "share")
    is_single = F.size("pattern") == 1
    d = sized.filter(is_single).join(F.broadcast(known.filter("single")), "pool").unionByName(sized.filter(~is_single).join(known.filter("NOT single"), "pool"))
    unit = 1 << STEPS
    d = d.withColumn("of", F.to_json("own")).withColumn("order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "body"), 64 - STEPS) - F.floor(F.col("share") * unit))
    d = d.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")))).otherwise(-1).cast("int"))
    d = d.withColumn("open", (F.col("share") > 0) | (F.col("single") & (F.col("whole") < cap)))
    d = stored(d.drop("single"), "mix-shares")
    counts = d.filter("open").groupBy("of", "class").agg(F.ceil(F.count(F.lit(1)) / BUCKET_DOCS).alias("buckets"), F.sum((F.col("share") * F.col("size")).cast("decimal(28,6)")).cast("double").alias("quota"))
    counts = stored(counts, "mix-buckets")
    # the order lies between -1 and 1 unit; a bucket has a unit's documents over the number of buckets, at most
    some = d.filter("open").join(counts, ["of", "class"]).withColumn("bucket", F.shiftright(F.shiftright(F.col("order") + unit, 12) * F.col("buckets"), STEPS - 12))
    bars = some.groupBy("of", "class", "bucket").agg(F.sum("size").alias("w"), F.first("quota").alias("quota"))
    of_class = Window.partitionBy("of", "class")
    bars = bars.withColumn("before", F.coalesce(F.sum("w").over(of_class.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the bucket in which the shares of the class end; buckets below it are taken whole
    edge = bars.filter((F.col("before") <= F.col("quota")) & (F.col("quota") < F.col("before") + F.col("w"))).select("of", "class", F.col("bucket").alias("edge"), F.col("before").alias("edge_before"))
    edge = stored(edge, "mix-edges")
    at_edge = some.join(edge, ["of", "class"]).filter(F.col("bucket") == F.col("edge")).groupBy("of", "class", "order").agg(F.sum("size").alias("w"), F.first("edge_before").alias("edge_before"), F.first("quota").alias("quota"))
    in_class = Window.partitionBy("of", "class").orderBy("order")
    at_edge = at_edge.withColumn("upto", F.col("edge_before") + F.sum("w").over(in_class.rowsBetween(Window.unboundedPreceding, 0))).withColumn("taken", F.col("upto") <= F.col("quota"))
    at_edge = stored(at_edge.select("of", "class", "order", "w", "edge_before", "quota", "upto", "taken"), "mix-at-edge")
    cut = at_edge.groupBy("of", "class").agg(F.max(F.when(F.col("taken"), F.col("order"))).alias("cut"), (F.first("quota") - F.coalesce(F.max(F.when(F.col("taken"), F.col("upto"))), F.first("edge_before"))).alias("left"))
    spare = at_edge.filter(~F.col("taken")).withColumn("turn", F.row_number().over(in_class)).filter(F.col("turn") <= SPARES)
    # at most SPARES documents of each class: an array of a few dozen
    offers = spare.groupBy("of").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("minus"), "class", "order"))).alias("offers"))
    lefts = F.aggregate(F.array_sort(F.collect_list("left")), F.lit(0.0), lambda acc, x: acc + x)
    fill = offers.join(cut.groupBy("of").agg(lefts.alias("left")), "of")
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<class:int,order:bigint>>").alias("got"))
    item = lambda x: F.struct(x["class"].alias("class"), x["order"].alias("order"))

    def step(acc: Column, x: Column) -> Column:
        fits = -x["minus"] <= acc["left"] + 0.5
        return F.struct(F.when(fits, acc["left"] + x["minus"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.concat(acc["got"], F.array(item(x)))).otherwise(acc["got"]).alias("got"))

    def near(acc: Column) -> Column:  # one that overshoots, if it comes nearer: the smallest such
        more = F.filter(F.col("offers"), lambda x: (-x["minus"] > acc["left"]) & (-x["minus"] < 2 * acc["left"]) & ~F.array_contains(acc["got"], item(x)))
        return F.when(F.size(more) > 0, F.concat(acc["got"], F.transform(F.slice(more, -1, 1), item))).otherwise(acc["got"])

    filled = fill.withColumn("got", F.aggregate("offers", start, step, near)).select("of", "got")
    ends = edge.join(cut, ["of", "class"]).join(counts.select("of", "class", "buckets"), ["of", "class"]).join(filled, "of", "left").select("of", "class", "edge", "cut", "buckets", "got")
    d = d.join(stored(ends, "mix-cuts"), ["of", "class"], "left")
    d = d.withColumn("bucket", F.shiftright(F.shiftright(F.col("order") + unit, 12) * F.col("buckets"), STEPS - 12))
    below = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("order") <= F.col("cut")))
    extra = F.coalesce(F.array_contains("got", F.struct("class", "order")), F.lit(False)) & (F.col("bucket") == F.col("edge"))
    plus = F.when(F.col("open") & (F.coalesce(below, F.lit(False)) | F.coalesce(extra, F.lit(False))), 1).otherwise(0)
    return d.select(*sized.columns, "source_size", "target", (F.col("whole") + plus).cast("long").alias("copies"))


def chosen(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, seed: int = 7) -> DataFrame:
    """select_documents() for all rows of docs."""
    sized = stored(sized_documents(docs, source_col), "sized")
    return select_documents(sized, stored(plan_mix(sized, cycle, cap), "mix-plan"), seed, cap)


def mix(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (copies times size) of each document.

    Null texts have size 0; null is a source of its own and comes last; repeated rows are documents of their
    own, taken alike; an empty table gives no rows; other columns are dropped. Equal texts in several sources overlap. A source_col of
    arrays says itself where sources overlap; then source_size and target are those of a row's first source in order. Null and empty
    arrays are in the null source.
    """
    out = chosen(docs, source_col, cycle, cap, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "body")


def mixed_documents(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (5.0, 2.0, 1.0), cap: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (a document without words: as its source's whole copies say).

    Only ids and hashes go through the choice; texts are joined to it once, as one column, so that names can't clash.
    """
    taken = chosen(docs, source_col, cycle, cap, seed).filter(F.col("copies") > 0).select(F.col("doc_id").alias("taken_id"), F.col("own").alias("taken_own"), F.col("body").alias("taken_body"), "copies")
    taken = stored(taken.distinct(), "mix-taken")
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"), own_sources(docs, source_col).alias("own"), text_hash(F.col("text")).alias("body"))
    out = whole.join(taken, F.col("id").eqNullSafe(F.col("taken_id")) & F.col("own").eqNullSafe(F.col("taken_own")) & (F.col("body") == F.col("taken_body")))
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
