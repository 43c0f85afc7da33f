"""Every registered query against its SQL on the small tables."""

import collections
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rel.fetchall()
    assert sorted(columns) == sorted(df.columns)
    assert len(got) == len(want)
    left, right = _rows(df.columns, got), _rows(columns, want)
    assert left == right, (list((left - right).items())[:3], list((right - left).items())[:3])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
