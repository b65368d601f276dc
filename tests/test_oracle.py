"""Every registered query against its independent SQL."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry
from marketlens import catalog, oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), oracle.queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []


def test_every_sql_is_registered():
    assert set(ORACLE) == set(QUERIES)
    assert set(ORACLE) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "quarter" and df.count() == 14
