"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import connect, difference

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["source", "items", "mean_length"]
    assert rows.count() > 0


def test_sql_has_no_strays():
    assert set(SQL) <= set(QUERIES)
