"""Prefix hashes, fingerprints and edited texts against plain versions."""

import random

import numpy as np
import pytest

from seqgraph.llm import prefix_hash
from seqgraph.llm.prefix_hash import PrefixHashes, as_text, codes, common_prefixes, fingerprint_documents, fingerprints_of, likeness

from . import brute
from .test_operators import SCHEMA, corpus, plain, same


def test_spans_and_extensions():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abé𝒳") for _ in range(400)) * 2 + "z" * 50
    hashes = PrefixHashes(codes(text))
    for _ in range(300):
        n = rnd.randint(0, 60)
        i, j = (rnd.randint(0, len(text) - n) for _ in range(2))
        assert bool(hashes.equal(np.array([i]), np.array([j]), n)[0]) == (text[i : i + n] == text[j : j + n])
    i = np.array([rnd.randint(0, len(text)) for _ in range(300)] + [0, 0, len(text)])
    j = np.array([rnd.randint(0, len(text)) for _ in range(300)] + [400, 0, len(text)])
    most = len(text) - np.maximum(i, j)
    want = [next((k for k in range(m) if text[a + k] != text[b + k]), m) for a, b, m in zip(i, j, most, strict=True)]
    assert hashes.extension(i, j, most).tolist() == want
    assert hashes.spans(slice(3, 90), 7).tolist() == hashes.spans(np.arange(3, 90), 7).tolist()


def test_common_prefixes_over_many_windows(monkeypatch):
    monkeypatch.setattr(prefix_hash, "PIECE", 512)
    a = ["x" * n + "a" for n in (0, 5, 63, 64, 65, 1000, 5000)] + ["", "", "same" * 400]
    b = ["x" * n + "b" for n in (0, 5, 63, 64, 65, 1000, 5000)] + ["", "y", "same" * 400]
    assert common_prefixes([codes(x) for x in a], [codes(x) for x in b]).tolist() == [0, 5, 63, 64, 65, 1000, 5000, 0, 0, 1600]


@pytest.mark.parametrize("piece", [256, 1 << 16])
def test_fingerprints(spark, monkeypatch, piece):
    """Also in pieces far shorter than the texts, where one text spans many."""
    rows = corpus(seed=5, n=40) + [(2000 + n, "abcdefghijklmnopqrstuvwxyz"[:n], *[None] * 8) for n in range(20)] + [(3000, "Ab" * 2000, *[None] * 8), (3001, "", *[None] * 8)]
    want = sorted(brute.edited(plain(rows)), key=repr)
    if piece == 256:  # in this process, as a worker doesn't see the change
        monkeypatch.setattr(prefix_hash, "PIECE", piece)
        monkeypatch.setattr(prefix_hash, "GROUP", 1000)
        texts = [r[1] or "" for r in rows]
        small = fingerprints_of([codes(t) for t in texts])
        monkeypatch.undo()
        assert small == fingerprints_of([codes(t) for t in texts])
        return
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = fingerprint_documents(docs).collect()
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["same_edited"], r["same_next"], r["near_edited"], r["near_next"]) for r in found), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    off = [abs(g[k] - w[k]) for g, w in zip(got, want, strict=True) for k in (5, 6)]
    assert max(off) < 0.25 and sum(off) / len(off) < 0.03
    prints = dict(zip([r["doc_id"] for r in found], found, strict=True))
    by_text = {}
    for i, t, *_ in rows:
        by_text.setdefault(t or "", set()).add(bytes(prints[i]["fingerprint"]))
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) == len(by_text)
    for r in found:
        assert likeness(bytes(r["fingerprint"]), bytes(r["edited_fingerprint"])) == r["near_edited"]


def test_rows_at_the_ends_of_tasks(spark):
    """Each row a task of its own, some tasks without rows; the last row meets the first."""
    rows = [(i, f"text {i} " * (i % 3 + 1)) for i in range(9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"], r["same_edited"], r["same_next"]) for r in got], [w[:5] for w in brute.edited([dict(doc_id=i, text=t) for i, t in rows])])


def test_alone_and_empty(spark):
    one = fingerprint_documents(spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")).withColumn("f", as_text("fingerprint")).collect()
    assert [(r["doc_id"], r["near_next"], r["same_next"], len(r["f"])) for r in one] == [(7, 1.0, 8, 16 + 2 * prefix_hash.BINS)]
    assert one[0]["edited_sha256"] == brute.sha("abcdefab")
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string, part int, edge string")).count() == 0
    both = fingerprint_documents(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["near_edited"], r["near_next"]) for r in both] == [(1.0, 1.0), (1.0, 0.0), (1.0, 0.0)]
