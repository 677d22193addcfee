"""Keys in one pass against their SQL, and what queries over chord lines store."""

import random
import sys

import pytest

from seqgraph.operators import keys as Y
from seqgraph.operators import theory as T
from seqgraph.plans import harmony as H
from seqgraph.sources.fixtures import clustered, isolated

SYMBOLS = ("C", "G7", "F", "Dm", "Bdim", "Am/C", "Em7", "H?", "Ebmaj7", "Fm", "D7")


def chord_rows(songs=60, seed=3):
    """Lines of songs of one to six sections of one to twelve chords; a section often comes again."""
    r, rows = random.Random(seed), []
    for song in range(songs):
        sections = [[r.choice(SYMBOLS) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 6))]
        sections += [r.choice(sections) for _ in range(r.randint(0, 4))]
        r.shuffle(sections)
        rows += [(song, i, "verse", "g", "d", None, j, x) for i, s in enumerate(sections) for j, x in enumerate(s)]
    return rows


@pytest.mark.parametrize("chunk", [1, 50, 100_000])
def test_keys_in_one_pass_as_in_sql(spark, monkeypatch, chunk):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(Y, "CHUNK", chunk)
    rows = chord_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE lines (song BIGINT, ordinal BIGINT, section VARCHAR, genre VARCHAR, decade VARCHAR, external_id VARCHAR, pos BIGINT, symbol VARCHAR)")
    con.executemany("INSERT INTO lines VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    known = [*T.chord_dim(T.DUCK), *T.KEY_DIMS, *T.key_scores("ch", "skeys"), *T.song_keys(T.DUCK)]
    want = con.execute(T.query([*known, f"bk AS ({T.best_keys('skeys')})"], "SELECT s.song, s.ordinal, s.key_no, round(s.p, 7), g.key_no, round(g.p, 7), round(b.p, 7), round(b.second_p, 7), b.n FROM section_key s JOIN song_key g USING (song) JOIN bk b USING (song, ordinal) ORDER BY 1, 2")).fetchall()
    ch = con.execute(T.query(T.chord_dim(T.DUCK), "SELECT song, ordinal, canon FROM ch ORDER BY song, ordinal, pos")).to_arrow_table()
    got = [x for b in Y._keys(iter(ch.to_batches(max_chunksize=37))) for x in b.to_pylist()]
    assert [(x["song"], x["ordinal"], x["key_no"], round(x["p"], 7), x["song_no"], round(x["song_p"], 7), round(x["best_p"], 7), round(x["second_p"], 7), x["n"]) for x in got] == want
    grid = con.execute(T.query([*known, *T.key_grid("skeys_x", "song_key")], "SELECT point, CAST(bin AS BIGINT), n, round(p, 7), hits, seconds FROM g4 ORDER BY 1, 2")).fetchall()
    parts = [x for b in Y._grid(iter(ch.to_batches(max_chunksize=41)), T.GRID) for x in b.to_pylist()]
    assert [(x["point"], x["bin"], x["n"], round(x["p"] / x["n"], 7), x["hits"], x["seconds"]) for x in parts] == grid


def stored_by(monkeypatch, run):
    """Names of the tables that run() stores."""
    names = []
    for module in list(sys.modules.values()):
        for f in ("materialize", "clustered"):
            old = getattr(module, f, None)
            if callable(old) and getattr(module, "__name__", "").startswith("seqgraph"):
                monkeypatch.setattr(module, f, lambda df, name, *more, old=old: (names.append(name), old(df, name, *more))[1])
    run()
    return names


@pytest.mark.parametrize("query", ["key_grid_search", "functions", "song_key", "modulations"])
def test_no_row_for_each_key_is_stored(spark, monkeypatch, query):
    names = stored_by(monkeypatch, lambda: H.QUERIES[query](spark, "/root/testdata/sf0.001").count())
    assert names and not {"skeys", "skeys_x", "ch", "roman"} & set(names)


def test_stored_lines_need_no_shuffle_by_song(spark):
    own = isolated(spark)
    lines = own.createDataFrame(chord_rows(), "song long, ordinal long, section string, genre string, decade string, external_id string, pos long, symbol string")
    clustered(lines.repartition(4, "song"), "lines", "ordinal", "pos").createOrReplaceTempView("lines")
    q = own.sql("SELECT *, lead(symbol) OVER (PARTITION BY song, ordinal ORDER BY pos) AS nxt FROM lines")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan and q.count() == len(chord_rows())


@pytest.mark.parametrize(("query", "never"), [("color_compare", {"arc", "arc_end", "facts", "cseq"}), ("perceptual_axes", {"arc", "arc_end", "facts", "cseq"}), ("explain_edge", {"cedges", "cnodes", "color", "windows"}), ("graph_nodes", {"cedges", "cnodes", "color", "near", "rtr"}), ("node_lookup", {"cedges", "cnodes", "color", "frequent", "near"})])
def test_only_what_is_read_is_stored(spark, monkeypatch, query, never):
    from seqgraph.plans import color, reports

    known = color.QUERIES | reports.QUERIES
    names = stored_by(monkeypatch, lambda: known[query](spark, "/root/testdata/sf0.001").count())
    assert names and not never & set(names)
