import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "p5_found" in sql


@pytest.mark.skipif(not os.path.exists(ROOT), reason="no test tables")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
