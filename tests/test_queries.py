"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = sorted(tuple(map(str, (r[c] for c in sorted(got.columns)))) for r in got.collect())
    result = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(got.columns)
    assert rows == sorted(tuple(str(r[i]) for i in order) for r in result.fetchall())


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
