"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import compare
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from cotflow.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(con, spark, SF_DIR, QUERIES[name], SQL[name]) == []


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"reasoning_paths_full"}


def test_registered_queries_are_offered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["bucket"] for r in rows} <= {"single_path", "2-10_paths", "11-100_paths", "100+_paths"}
    assert sum(r["examples"] for r in rows) > 0
