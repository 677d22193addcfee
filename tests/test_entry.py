"""The registry: names, SQL for the same keys, the flagship query, and imports without the corpus operators."""

import importlib.util
import subprocess
import sys

import pytest


def test_registry():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(f) for f in queries.values())


def test_flagship(spark):
    import os

    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    rows = e.entry(spark)
    assert rows.columns == ["context", "from_token", "to_token", "count", "prob", "pmi", "support"] and rows.count() > 0


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys; import seqgraph.plans as p; p.queries(); print(any(m.startswith('seqgraph.llm') for m in sys.modules))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=importlib.util.find_spec("__spark_entry__").origin.rpartition("/")[0])
    assert done.stdout.strip() == "False", done.stderr
