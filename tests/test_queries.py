"""Every registered query against its SQL on the test tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry
from tideline.plans import oracle
from tideline.plans.queries import queries as registered

QUERIES, SQL = registered(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare.difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
