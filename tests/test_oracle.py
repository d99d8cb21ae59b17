"""Every query against its SQL in DuckDB."""

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from conftest import DATA
from tools.compare import connect, difference

# The operators of the optional subpackage have tests of their own.
SQL = {name: text for name, text in oracle_sql().items() if not name.startswith("op") and name != "pipeline"}
QUERIES = {name: run for name, run in queries().items() if not name.startswith("op") and name != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    return connect(f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    problem = difference(QUERIES[name](spark, f"{DATA}/sf0.001"), duck, SQL[name])
    assert problem is None, problem


def test_every_sql_has_a_query_and_only_the_model_has_none():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"impressions_model"}


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
