"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from veridraft.plans.registry import all_queries
from tools.compare import open_tables, problems_of

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(all_queries()))
def test_matches_sql(spark, con, name):
    _rows, problems = problems_of(QUERIES[name](spark, FOLDER), con, SQL.get(name))
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_own_queries_have_sql():
    assert set(all_queries()) <= set(SQL)
