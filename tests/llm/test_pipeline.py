"""Every stage of the pipeline on its own input, against plain versions, and run() as their chain."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from seqgraph.llm.mixing import capped_targets
from seqgraph.llm.token_files import Encoder, default_tokenizer

from . import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4)))
    vocab = [word() for _ in range(500)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(30))) for i in range(5)]
    rows = []
    for i in range(90):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(60, 200)))
        if i % 9 == 0:
            text = items[i % 5][1] + " " + text
        if i % 10 == 3 and i > 10:
            text = rows[i - 7][1]
        if i % 10 == 5 and i > 10:
            text = rows[i - 8][1] + " end"
        if i % 13 == 0:
            text = " ".join(w + "###" for w in text.split())
        if i % 17 == 0:
            text = "too short"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " ".join(rnd.choice(vocab) for _ in range(70)), None, None, None)]
    long = " ".join(rnd.choice(vocab) for _ in range(500))
    rows.append((903, long + " " + items[0][1][: items[0][1].rindex(" ")].rsplit(" ", 15)[0], "en", "s2", 1))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), plain(spark.read.parquet(f"{folder}/benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "token files"]

    def step(name, given):
        out = stages[name](spark, given, folder).cache()
        assert name == "token files" or out.schema.simpleString() == docs.schema.simpleString()
        return out

    kept = step("quality rules", docs)
    failed = {r[0] for r in brute.rules(plain(docs)) if r[6] or 10 * r[3] > r[1]}
    assert sorted(r["doc_id"] for r in plain(kept)) == sorted(r["doc_id"] for r in plain(docs) if r["doc_id"] not in failed)

    unique = step("SimHash near-dedup", kept)
    assert sorted(r["doc_id"] for r in plain(unique)) == sorted({r[2] for r in brute.near_duplicates(plain(kept))})
    assert unique.count() < kept.count()

    clean = step("benchmark decontamination", unique)
    told = {r[0]: r for r in brute.contamination(plain(unique), items)}
    assert sorted(r["doc_id"] for r in plain(clean)) == sorted(d for d, r in told.items() if not r[5])
    for r in plain(clean):
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.low(r["text"]))) == told[r["doc_id"]][1] - told[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
    assert any(r[2] and not r[5] for r in told.values())

    mixed = step("mixing sources", clean)
    given, times = {r["doc_id"]: r for r in plain(clean)}, {}
    for r in plain(mixed):
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r == given[r["doc_id"]]
    assert max(times.values()) <= 3
    names = sorted({r["source"] for r in given.values()}, key=lambda x: (x is None, x or ""))
    size = lambda r: len(brute.WORD.findall(r["text"]))
    sizes = [sum(size(r) for r in given.values() if r["source"] == n) for n in names]
    for n, target in zip(names, capped_targets(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]), strict=True):
        own = [r for r in given.values() if r["source"] == n]
        assert abs(sum(size(r) * times.get(r["doc_id"], 0) for r in own) - target) <= max(0.05 * target, max(map(size, own)) / 2)

    tokens = sorted((tuple(r.values()) for r in plain(step("token files", mixed))), key=lambda r: r[1])
    encoder, at = Encoder(default_tokenizer()).tokenizer, 0
    for got, r in zip(tokens, sorted(plain(mixed), key=lambda r: r["doc_id"]), strict=True):
        ids = [*encoder.encode(r["text"], add_special_tokens=False).ids, 0]
        assert got == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted((tuple(r.values()) for r in plain(corpus_pipeline.run(spark, folder))), key=lambda r: r[1]) == tokens


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
