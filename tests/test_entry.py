"""The driver contract."""

import os

import pytest

import __spark_entry__ as entry


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries) and all(map(callable, queries.values()))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "name", "unique_name"] and out.count() > 0
