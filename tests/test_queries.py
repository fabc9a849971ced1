"""Every registered query with SQL against that SQL in DuckDB, on whole tables of the small scale."""

import os
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SQL = entry.registry.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


def rows(df):
    def cell(v):
        if v is None or v is pd.NaT or pd.isna(v):
            return ""
        return (f"{v:.9g}" if abs(v) >= 1e15 or v != int(v) else str(int(v))) if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["x1"]


@pytest.mark.parametrize("name", sorted(set(entry.registry.queries()) - set(SQL)))
def test_without_sql_runs(spark, name):
    entry.queries()[name](spark, DATA).collect()
