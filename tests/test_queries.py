"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from tests.compare import check
from tidemark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    check(catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name]))

#: Queries whose values other tests hold against brute force, on the same tables.
HELD = {"block_ratings", "tuned_ratings", "ridge_rates", "calibrators", "stacking", "row_bootstrap"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - HELD))
def test_query_without_sql_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
