"""Every registered relational query against DuckDB on the smallest tables."""

import glob
import os
import warnings

import duckdb
import pytest

from arbora.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def cells(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    warnings.simplefilter("ignore")
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns
    if name in ORACLE:
        done = duck.execute(ORACLE[name])
        assert cells(rows, df.columns) == cells(done.fetchall(), [d[0] for d in done.description])
