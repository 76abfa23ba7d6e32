import pytest

import __spark_entry__ as entry
from quarry.llm import queries
from tests.oracle import SF, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, queries.QUERIES[name], queries.SQL[name])


def test_registered(spark):
    assert queries.QUERIES.keys() <= entry.queries().keys() and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
