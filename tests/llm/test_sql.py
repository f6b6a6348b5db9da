"""Queries that SQL can express against their SQL, over whole tables."""

import pytest

import cases
from comparison import connect, differences
from driftwarden.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(cases.SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert differences(queries.queries()[name](spark, cases.SF), con, SQL[name]) == []
