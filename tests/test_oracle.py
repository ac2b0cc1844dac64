"""Every query of the engine against its SQL in DuckDB."""

import decimal
import os

import duckdb
import pytest

from tracelake import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, decimal.Decimal)):
        return str(int(x))
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted(tuple(cell(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(cell(r[k]) for k in at) for r in want.fetchall())
    assert a == b
