"""Every registered query with SQL gives the SQL's rows; the entry points work with and without the optional subpackage."""

import datetime
import decimal
import importlib
import os
import subprocess
import sys

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows(values):
    return sorted((tuple(map(plain, r)) for r in values), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [list(want.columns).index(c) for c in df.columns]
    assert rows(df.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_llm_subpackage():
    """The package and the entry import where quillspark.llm can't be found."""
    code = "import sys; sys.modules['quillspark.llm'] = None\nimport __spark_entry__ as e\nassert not [n for n in e.queries() if n.startswith('op')] and 'pipeline' not in e.queries()\nassert len(e.queries()) > 100"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    for top, _, names in os.walk(os.path.join(ROOT, "quillspark")):
        for n in names:
            if n.endswith(".py") and "/llm" not in top:
                with open(os.path.join(top, n)) as f:
                    assert "quillspark.llm" not in f.read(), n


def test_modules_import():
    for m in ("functions.text", "operators.graph", "operators.retrieval", "sources.readers", "sources.stores", "streaming.incremental"):
        importlib.import_module(f"quillspark.{m}")


def test_gate_reaches_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillspark.operators.graph import visible

    spark.range(100).selectExpr("id as chapter_index", "id as paragraph_index").write.parquet(f"{tmp_path}/c")
    df = spark.read.parquet(f"{tmp_path}/c").where(visible(F.col("chapter_index"), F.col("paragraph_index"), 2, 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(LessThan(chapter_index,2)" in plan
