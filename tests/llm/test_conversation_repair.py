"""Repairs against a plain dynamic programme over strings, whole and in pieces."""

import itertools
import random

import numpy as np
import pytest

from seqgraph.llm.conversation_repair import Repairs, damage, repair, repair_conversations

from . import brute
from .test_operators import same

SCHEMA = "conv_id long, turn long, role string, text string"


def rows(seed=2, conversations=60, most=14):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "What?", "and then", "", "  \t", None, "Well.\n ", "a.　", "é!", "Yes.", "..", "x\ny."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ambient"]
    out = []
    for c in range(conversations):
        turns = list(range(rnd.randint(0, most)))
        out += [(c, t if rnd.random() > 0.05 else None, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"Text {t}.") for t in turns if rnd.random() > 0.1]
        if c % 9 == 0 and turns:
            out += [(c, rnd.choice(turns), rnd.choice(roles), rnd.choice(texts)) for _ in range(4)]
    out += [(None, t, r, "Hello.") for t, r in enumerate(("system", "user", "assistant"))] + [out[0], out[0]]
    out += [(900, None, "user", "no turn at all."), (901, -(1 << 62), "user", "A."), (901, 1 << 62, "assistant", "B.")]
    out += [(902, t, "user" if t % 2 else "assistant", "long " * 50 + f"{t}.") for t in range(150)]
    out += [(903, 5, "assistant", "Same.")] * 90 + [(904, t, "system", "s.") for t in range(40)]
    rnd.shuffle(out)
    return out


def columns(df):
    return [tuple(r)[:9] for r in df.collect()]


def test_repairs(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "x", 3) for r in given], SCHEMA + ", symbol string, copies int").repartition(3)
    want = list(brute.repairs(given))
    same(columns(repair_conversations(df)), want)
    assert {e for w in want for e in w[7]} == set("DIKR") and any(not w[7] for w in want)


@pytest.mark.parametrize("most_rows", [1, 3, 32])
def test_repairs_in_pieces(spark, most_rows):
    """All but the shortest conversations are cut, and dealt out to several tasks."""
    given = rows(seed=most_rows, conversations=25)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    same(columns(repair(damage(df), most_rows=most_rows)), list(brute.repairs(given)))


def test_large_by_bytes(spark):
    given = rows(conversations=4)
    same(columns(repair(damage(spark.createDataFrame(given, SCHEMA)), most_bytes=2000)), list(brute.repairs(given)))


def test_all_short_role_strings():
    """Every string of up to five rows, each kept or required to go: costs and audits by exhaustion."""
    names = {0: "t", 1: "s", 2: "u", 3: "a"}

    def legal(x):
        x = x.removeprefix("s") if x.startswith("sua") else x
        return x == "ua" * (len(x) // 2)

    def all_edits(symbols):
        best = None
        for n in range(len(symbols) + 1):  # how many rows stay
            for kept in itertools.combinations(range(len(symbols)), n):
                for target in ("ua" * 4, "s" + "ua" * 4):
                    for size in range(0, 8):
                        word = target[:size]
                        if not legal(word) or size < n:
                            continue
                        for places in itertools.combinations(range(size), n):
                            roles = [word[p] for p in places]
                            if any(r == "s" and symbols[k] != 1 for r, k in zip(roles, kept, strict=True)) or any(word[p] == "s" for p in range(size) if p not in places):
                                continue
                            cost = 2 * sum(names[symbols[k]] != r for r, k in zip(roles, kept, strict=True)) + 3 * (len(symbols) - n) + 2 * (size - n)
                            best = cost if best is None else min(best, cost)
        return best

    lists = [list(s) for n in range(4) for s in itertools.product(range(4), repeat=n)]
    found = Repairs([np.array(s, np.int64) for s in lists], np.tile([0, 1 << 40, 1 << 40, 0], (len(lists), 1)))
    for k, s in enumerate(lists):
        assert found.cost[found.first[k], 0] == all_edits(s), s


def test_empty(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
