"""Queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_module
from pricelode.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return "null" if v is None else float(f"{v:.6g}") if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    own = [d[0] for d in cursor.description]
    assert sorted(own) == columns
    want = sorted(str([plain(r[own.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
