import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle_check import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF, name, entry.queries()[name], SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 700
