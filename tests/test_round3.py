"""Plans of queries whose cost grew faster than it had to."""

from __future__ import annotations

import re

from tidemark.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_temperatures_are_tried_on_distinct_rows(spark, sf):
    """Equal vectors with equal outcomes are one row with a number; before, every row was raised to every temperature."""
    inner = [a for a in re.findall(r"Aggregate \[([^\]]*)\]", plan(QUERIES["temperature_grid"](spark, sf))) if "p0#" in a and "y#" in a]
    assert inner


def test_met_opponents_carry_little(spark, sf):
    """The rows of opponents met (ten for each row asking) carry a number, a time, the opponent and a count; before, they carried all columns of the row asking and its level."""
    exploded = [g for g in re.findall(r"Project \[([^\]]*)\]\s*\n[^\n]*Generate explode\(held", plan(QUERIES["opponent_adjusted_mean"](spark, sf)))]
    assert exploded and all("contest_id#" not in g and "entity_id#" not in g for g in exploded)


def test_trees_read_written_rows(spark, sf, monkeypatch):
    """The fit reads its rows several times, so they are written once; before, each pass made both as-of joins again."""
    from tidemark.plans import fit_plans

    names = []
    kept = fit_plans.written
    monkeypatch.setattr(fit_plans, "written", lambda df, name: names.append(name) or kept(df, name))
    assert QUERIES["tree_forecast"](spark, sf).count() == 1000 and names == ["tree-rows"]


def test_an_entity_is_one_row_under_all_variants(spark, monkeypatch):
    """State and joins hold an entity and a contest once, with a column a variant, and a large block is several files; before, both were one row a variant and a block was one file."""
    from tidemark.operators import ratings

    held, kept, rows = [], ratings.written, spark.range(60).selectExpr(
        "id contest", "id div 30 block", "id div 30 + 1 known", "id % 7 l", "(id + 3) % 7 r", "id % 2 lg", "(id + 1) % 2 rg", "'s' season", "id % 3 = 0 bridge", "cast(id % 3 as int) y", "1 margin"
    )
    monkeypatch.setattr(ratings, "written", lambda df, name: held.append((name, kept(df, name))) or held[-1][1])
    monkeypatch.setattr(ratings, "LOT_ROWS", 5)
    found = ratings.replay(rows, {"a": ratings.Rules(), "b": ratings.Rules(k=40.0)}, ("y",)).collect()
    assert len(found) == 120 and len({(r.variant, r.contest) for r in found}) == 120
    states = [df for name, df in held if name == "rating-state"]
    assert len(states) == 2 and all(df.count() == 7 and {"r0", "r1"} <= set(df.columns) for df in states)


def test_plug_ins_read_the_frame_once(spark, sf):
    """All plug-ins read one pass over the common frame; before, each made its own, joins and windows included."""
    for name in ("plugin_statuses", "stage_snapshots"):
        assert "Union" not in plan(QUERIES[name](spark, sf)).split("Join LeftOuter")[0]
