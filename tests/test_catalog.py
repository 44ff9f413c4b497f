"""Every registered query runs at the smallest scale; those with SQL must agree with it."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "scripts"))

from check_catalog import TABLES, rows_of
from conftest import SF
from noviscan.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    res = con.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())


# Longer runs are covered by their batch parts above and by the tests of single operators.
LONG = {"prj22_plan_topics", "str4_streaming_novelty"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - LONG))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).collect() is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_folders(tmp_path):
    """A copy without the subpackage for training data, with and without the pipeline file."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "noviscan"), tmp_path / "noviscan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    told = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q))"
    for name in (None, "corpus_pipeline.py"):
        if name and os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
        ran = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert ran.stdout.split() == [str(len(QUERIES)), "False", "False"], ran.stderr[-500:]
