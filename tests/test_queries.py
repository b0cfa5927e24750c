"""Every query with SQL has the same rows in DuckDB."""

import glob
import os
import warnings

import duckdb
import pytest

from tidewire.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    warnings.filterwarnings("ignore")
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert name in ORACLE
    got = duck.execute(ORACLE[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in got.fetchall())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
