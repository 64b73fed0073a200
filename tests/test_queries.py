"""Registered queries against their SQL in DuckDB, and the driver contract."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from braidpath.plans.oracle import SQL
from braidpath.plans.queries import QUERIES
from braidpath.sources import tables
from tests.conftest import DATA, ROOT

TABLES = "customer events embeddings lineitem orders"


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: repr(round(v, 7) + 0.0) if isinstance(v, float) else repr(v)
    return sorted(tuple(clean(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, DATA)
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want.columns, want.fetchall()) == rows(got.columns, got.collect())


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 388


def test_files(spark, tmp_path):
    bars = tmp_path / "bars.csv"
    bars.write_text("date,ticker,open,high,low,close,adj_close,volume\n2020-01-02,A,1,2,1,2,2,100\n")
    df = tables.ohlcv(spark, str(bars))
    assert df.first()["adj_close"] == 2.0
    tables.write_csv(df, str(tmp_path / "csv"))
    tables.write_parquet(df, str(tmp_path / "parquet"), by=["ticker"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 1
    (tmp_path / "empty.csv").write_text("date,ticker,open,high,low,close,adj_close,volume\n")
    with pytest.raises(ValueError):
        tables.ohlcv(spark, str(tmp_path / "empty.csv"))


def test_library_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(f"{ROOT}/braidpath", tmp_path / "braidpath", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
