"""Every query of the engine against its SQL."""

from __future__ import annotations

import pytest
from conftest import duck, same_rows

import __spark_entry__ as entry
from tessella.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    query, sql = QUERIES[name]
    assert sql is not None
    same_rows(query(spark, sf), con, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
