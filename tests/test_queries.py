"""Every core query against its SQL, on the smallest test tables."""

import glob
import os
import subprocess
import sys
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from siltstone.plans import catalogue


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    got = df.collect()
    if name not in catalogue.SQL:
        assert got, name
        return
    cursor = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, cursor.fetchall())


def test_entry(spark, data):
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "point_id", "score", "rank"]


def test_from_another_folder(data, tmp_path):
    """Executors get the package from the driver, wherever it was started."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["html_main_text"](spark, {data!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
