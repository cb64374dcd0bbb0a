"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import pytest

from gradeloom.queries.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.6g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in ORACLES:
        rel = con.execute(ORACLES[name])
        have = [d[0] for d in rel.description]
        assert sorted(have) == cols
        assert got == sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    else:
        assert got
