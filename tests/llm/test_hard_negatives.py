"""Hard negatives against all scores, with ties, repeated rows, ragged and unusable vectors, and few or many shards."""

import math
import random

import numpy as np
import pytest

from seqgraph.llm.hard_negatives import Best, Seek, Shard, hard_negatives, integer_rows, mine

SCHEMA = "vec_id long, label int, embedding array<double>, id string, score int"


def given(seed=1, n=900, dims=6):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    out = []
    for i in range(n):
        m = rnd.choice(middles)
        v = [round(x + rnd.gauss(0, 0.2), 1) for x in m]  # coarse: many ties
        out.append((i, rnd.randint(0, 9), v, "x", 1))
    out += [(300, None, [1.0] * dims, "x", 1), (1000, 3, None, "x", 1), (1100, 3, [1.0, None], "x", 1), (1200, 3, [math.nan] * dims, "x", 1), (1300, 3, [math.inf], "x", 1)]
    out += [(1400, 4, [0.5], "x", 1), (1500, 4, [], "x", 1), (None, 4, [2.0] * dims, "x", 1), (None, 5, [2.0] * (dims + 2), "x", 1), out[100], out[100], (-100, 2, [-1.0] * dims, "x", 1), (-7, 9, [1.5] * dims, "x", 1), (1600, 6, [1e30, -1e300, 1.0], "x", 1)]
    rnd.shuffle(out)
    return out


def plain(rows, every=100, k=5):
    usable = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v]) for i, lab, v, *_ in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for _, _, v in usable), default=0)
    x = np.array([v + [0] * (dims - len(v)) for _, _, v in usable], np.int64).reshape(len(usable), dims)
    for a, (i, lab, _) in enumerate(usable):
        if i is None or i % every:
            continue
        scores = (x @ x[a]).tolist()
        order = sorted((r for r in range(len(usable)) if r != a), key=lambda r: (-scores[r], usable[r][0] is None, usable[r][0] or 0))
        for p in [r for r in order if usable[r][1] == lab][:k]:
            for rank, r in enumerate([r for r in order if usable[r][1] != lab and 80 * scores[p] <= 100 * scores[r] <= 100 * scores[p]][:k], 1):
                yield i, usable[p][0], rank, usable[r][0], scores[p], scores[r]


@pytest.mark.parametrize(("cells", "anchors", "dims"), [(1 << 18, 1 << 15, 6), (600, 3, 6), (3000, 4, 2), (1, 1000, 3)])
def test_mine(spark, cells, anchors, dims):
    rows = given(seed=dims, n=900 if cells > 1 else 150, dims=dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, mine(integer_rows(df), cells=cells, anchors=anchors).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr) and len(got) > 50


def test_an_anchor_leaves_early():
    """Clustered rows of few dimensions: the threshold falls below the fifth score long before all rows are scored, and a far shard is never read."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 3, (1000, 2)) for c in ((200, 200), (-200, -200), (0, 0), (50, -50))]).astype(np.int32)
    shard = Shard(0, list(range(4000)), [1] * 4000, 2, x.tobytes(), np.argsort(x.T, axis=1, kind="stable").astype(np.uint16).tobytes())
    seek = Seek(np.array([[10, 1]], np.int32), np.array([1]), np.array([[9, 9]]), np.array([0]), np.full((1, 1), -(1 << 62)), np.full((1, 1), 1 << 62), True, 5)
    scored = seek.visit(shard)
    want = sorted((x.astype(np.int64) @ [10, 1]).tolist(), reverse=True)[:5]
    assert seek.best.score.tolist() == want and scored < 2000
    away = -np.abs(x)
    far = Shard(1, list(range(4000)), [1] * 4000, 2, away.tobytes(), np.argsort(away.T, axis=1, kind="stable").astype(np.uint16).tobytes())
    assert seek.visit(far) == 0 and seek.best.score.tolist() == want


def test_best_of_groups():
    best = Best(3, 2)
    one = lambda *v: np.array(v, np.int64)
    best.add(one(0, 0, 2), one(5, 5, 1), one(9, 3, 4), np.array([True, True, True]))
    best.add(one(0, 2, 2), one(5, 7, 1), one(0, 1, 0), np.array([False, True, True]))
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 5, 3), (0, 5, 9), (2, 7, 1), (2, 1, 0)]
    assert best.kth().tolist() == [5, -(1 << 62), 1]


def test_whole_query(spark):
    rows = [(i, i % 10, np.random.default_rng(i).normal(0, 0.125, 64).tolist(), "x", 1) for i in range(1200)]
    got = sorted(map(tuple, hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)


def test_empty(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(100, None, None, "x", 1), (200, 1, [], "x", 1)], SCHEMA)).count() == 0
