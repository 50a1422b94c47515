"""Queries with SQL give the rows that DuckDB gives; every other one has a test of its own."""

import glob
import os

import duckdb
import pytest

from tidewatch.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == want


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
