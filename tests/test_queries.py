"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="session")
def con():
    return connect(SF)


def test_flagship(spark):
    assert contract.entry(spark).columns == ["host", "urls"]


def test_every_sql_twin_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0
