"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

from tilewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == cols
    want = sorted(repr([value(row[names.index(c)]) for c in cols]) for row in cursor.fetchall())
    assert sorted(repr([value(row[c]) for c in cols]) for row in df.collect()) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
