"""Every registered query gives the rows its SQL gives, with the same names and types."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from cellhealth.plans import oracle, registry
from conftest import MEDIUM, SMALL
from oracle_check import connect, difference

QUERIES = registry.queries()
SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).count() == 397


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, MEDIUM), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
