"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, tiny, name):
    assert compare(spark, con, tiny, name, QUERIES[name], SQL[name]).startswith("ok")


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0


def test_every_sql_twin_is_registered():
    assert set(SQL) <= set(QUERIES)
