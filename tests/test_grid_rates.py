"""Grids are made for distinct rates, not for rows."""

from __future__ import annotations

import pytest

from tidemark.plans import catalog

GRIDS = ["exact_scores", "side_markets", "rescaled_grid", "grid_markets", "in_play", "total_counts"]


@pytest.mark.parametrize("name", GRIDS)
def test_grids_are_made_once_a_pair_of_rates(spark, sf, name):
    """No grid is worked out row by row: the rows only meet what was written for the distinct rates."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
