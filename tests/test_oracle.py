"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from pixelmill import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(map(tuple, frame.values.tolist()), key=lambda r: [(v is None, 0 if v is None else v) for v in r])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = plans.QUERIES[name](spark, DATA).toPandas()
    theirs = duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
