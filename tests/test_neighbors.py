"""Nearest vectors in blocks and by the index, against all products."""

import numpy as np
import pytest

from seqgraph.operators import graph as G
from seqgraph.operators import neighbors as N


def given(spark, n=900, dims=16, clusters=30, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims))
    x = middle[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, dims))
    rows = [(i, i % 2, v.tolist()) for i, v in enumerate(x)]
    rows += [(n, 0, x[4].tolist()), (n + 1, 0, x[4].tolist()), (n + 2, 0, [0.0] * dims), (n + 3, 1, None), (None, 1, x[0].tolist()), (n + 4, None, x[0].tolist())]
    return spark.createDataFrame(rows, "id long, model long, vec array<double>").repartition(3).cache()


def triples(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["cosine"], 8) + 0.0) for r in df.collect())


@pytest.mark.parametrize("cells", [1 << 18, 400])
def test_blocks_equal_all_pairs(spark, cells):
    v = given(spark)
    q = v.filter("id % 50 = 0 OR id = 902")
    whole = v.filter("id IS NOT NULL AND vec IS NOT NULL AND model IS NOT NULL")
    assert triples(N.exact(q, v, 7, cells)) == triples(G.cosine_topk(q, whole, 7))


def test_index_finds_what_all_pairs_find(spark):
    v = given(spark, 3000).withColumn("model", G.F.lit(0))
    index = N.fit_index(v, recall=0.95, sample=2000)
    assert len(index.centroids) == 2000 // N.PER_CELL and index.probes < len(index.centroids) / 2
    q = v.filter("id % 50 = 0")
    rows = N.indexed(index, v).cache()
    assert rows.agg(G.F.sum("n")).first()[0] == v.filter("id IS NOT NULL AND vec IS NOT NULL").count()  # every row is in one cell
    found, true = N.approximate(index, q, rows), N.exact(q, v)
    got = N.recall(found, true).first()
    assert got["recall"] >= 0.9 and got["pairs"] == 10 * q.count()
    every = N.Index(index.centroids, len(index.centroids))
    assert triples(N.approximate(every, q, rows)) == triples(true)  # all cells: the same as exactly


def test_no_vectors(spark):
    v = given(spark).limit(0)
    index = N.fit_index(v)
    assert N.exact(v, v).count() == 0 and N.approximate(index, v, N.indexed(index, v)).count() == 0
