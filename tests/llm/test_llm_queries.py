"""Every registered query of the subpackage on the whole small tables, against its SQL where it has one."""

import os
from pathlib import Path

import pytest

from triplane import llm

DATA = "/root/testdata/sf0.001"
SQL = llm.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got, want = llm.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_runs(spark, name):
    if name.startswith("p6") and not Path("/opt/tokenizers").exists():
        pytest.skip("needs the vocabulary files")
    assert llm.queries()[name](spark, DATA).toPandas() is not None
