"""Queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gradeloom.llm.registry import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(oracle_sql()[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[have.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
