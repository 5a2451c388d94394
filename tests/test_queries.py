"""Every registered query against its SQL twin; those without one must run, and have tests of their own: a table may hold nothing to find."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.harness import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        found = queries()[name](spark, SF)
        assert found.columns and found.count() >= 0
    else:
        ok, message = compare(spark, con, queries()[name], sql, SF)
        assert ok, message


def test_entry(spark):
    assert entry(spark).count() == 500
