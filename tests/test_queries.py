"""All registered core queries: with SQL against DuckDB, without at least a result."""

import importlib

import pytest
from oracle import compare

from ranksight.plans import analytics, fixtures, maintenance, retrieval  # noqa: F401
from ranksight.plans.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    if name in SQL:
        compare(spark, sf, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry_point(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
