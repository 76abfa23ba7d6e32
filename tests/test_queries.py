import subprocess
import sys

import pytest

import __spark_entry__ as entry
from quarry import queries as base
from tests.conftest import ROOT
from tests.oracle import SF, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, con, name):
    compare(spark, con, base.QUERIES[name], base.SQL[name])


@pytest.mark.parametrize("name", sorted(base.QUERIES.keys() - base.SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "score"] and rows.count() == 20
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_everything_else_works_without_the_optional_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = sys.modules['quarry.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [k for k in q if k.startswith('op')] and 'pipeline' not in q and e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
