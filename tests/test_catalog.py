"""Every query with a SQL counterpart gives the same rows in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from orvane.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        cols = sorted(want.columns)
        assert cols == sorted(got.columns)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
        assert len(a) == len(b)
        for c in cols:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
