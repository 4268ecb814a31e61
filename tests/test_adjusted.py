"""Adjusted means against plain loops over small tables with ties, unsettled rows, repeated times and none at all."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from tidemark.operators.adjusted import adjusted_form, opponent_adjusted, overall_as_of, side_means
from tidemark.sources.tables import entity_rows

START = datetime(2024, 1, 1)
SCHEMA = "contest_id long, pool string, season timestamp, event_ts timestamp, available_at timestamp, left_id long, right_id long, left_n long, right_n long"


@pytest.fixture(scope="module")
def played():
    rng = random.Random(3)
    out = []
    for i in range(160):
        at = START + timedelta(hours=6 * (i // 4))  # four contests become known together
        left = rng.randrange(7)
        right = (left + 1 + rng.randrange(6)) % 7
        settled = rng.random() > 0.1
        out.append((i, "p", START, at, at + timedelta(hours=3) if i % 29 else None, left, right, rng.randrange(5) if settled else None, rng.randrange(4)))
    return out


def _views(played):
    rows = [r for r in played if r[7] is not None and r[4] is not None]
    both = [(r[0], "L", r[5], r[6], r[7], r[8], r[4]) for r in rows] + [(r[0], "R", r[6], r[5], r[8], r[7], r[4]) for r in rows]
    return sorted(both, key=lambda v: (v[6], v[0]))


def _asks(played):
    return [(r[0], side, entity, r[3] - timedelta(minutes=90)) for r in played for side, entity in (("L", r[5]), ("R", r[6]))]


def _close(got, want):
    assert len(got) == len(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12) if v is not None else got[k] is None, k


def test_side_means(spark, played):
    rows = entity_rows(spark.createDataFrame(played, SCHEMA))
    known, want = _views(played), {}
    for c, side, e, cutoff in _asks(played):
        for s in "LR":
            mine = [v for v in known if v[2] == e and v[1] == s and v[6] <= cutoff][-10:]
            want[c, side, s] = fmean(v[4] for v in mine) if len(mine) >= 3 else None
    got = side_means(rows.select("contest_id", "side", "entity_id", "cutoff"), rows).collect()
    _close({(r.contest_id, r.side, s): r[f"for_{n}"] for r in got for s, n in (("L", "left"), ("R", "right"))}, want)
    twice = rows.select("contest_id", "side", "entity_id", "cutoff")
    assert side_means(twice.unionByName(twice), rows).count() == 2 * len(got)


def test_opponent_adjusted(spark, played):
    rows = entity_rows(spark.createDataFrame(played, SCHEMA))
    known, want = _views(played), {}
    for c, side, e, cutoff in _asks(played):
        seen = [v for v in known if v[6] <= cutoff]
        mine = [v for v in seen if v[2] == e][-10:]
        conceded = {o: [v[5] for v in seen if v[2] == o] for o in range(7)}
        level = fmean(v[4] for v in seen) if seen else None
        want[c, side] = fmean(v[4] - (fmean(conceded[v[3]]) if len(conceded[v[3]]) >= 3 else level) for v in mine) if len(mine) >= 3 else None
    got = opponent_adjusted(rows.select("contest_id", "side", "entity_id", "cutoff"), rows).collect()
    _close({(r.contest_id, r.side): r.adjusted for r in got}, want)


def test_adjusted_form(spark, played):
    known, moves = _views(played), []
    for c, _, e, o, own, opp, at in known:
        before = [v for v in known if v[6] < at]
        level = fmean(v[4] for v in before) if before else 1.3
        theirs = [v for v in before if v[2] == o]
        rate = lambda i: (sum(v[i] for v in theirs) + 5 * level) / (len(theirs) + 5)  # noqa: B023, E731
        moves.append((e, at, own - rate(5), opp - rate(4)))
    want = {}
    for e, at, _, _ in moves:
        mine = [m for m in moves if m[0] == e and m[1] <= at][-10:]
        want[e, at] = (fmean(m[2] for m in mine), fmean(m[3] for m in mine)) if len(mine) >= 3 else (None, None)
    got = adjusted_form(entity_rows(spark.createDataFrame(played, SCHEMA))).select("entity_id", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "adj_att", "adj_def").collect()
    for i in (0, 1):
        _close({(r.entity_id, r["at"]): r[2 + i] for r in got}, {(e, at.strftime("%Y-%m-%d %H:%M:%S")): v[i] for (e, at), v in want.items()})


@pytest.mark.parametrize("strict", [False, True])
def test_overall(spark, strict):
    facts = [(START + timedelta(hours=h), v) for h, v in ((0, 1), (0, 2), (5, None), (30, 4), (30, 5), (80, 7))] + [(None, 9)]
    asks = [(k, t) for k, t in enumerate([START - timedelta(hours=1), START, START, START + timedelta(hours=30), START + timedelta(days=9), None])]
    a, f = spark.createDataFrame(asks, "k long, at timestamp"), spark.createDataFrame(facts, "known timestamp, v long")
    got = {r.k: (r.overall_sum, r.overall_n) for r in overall_as_of(a, f, "at", "known", "v", strict).collect()}
    for k, t in asks:
        held = [v for at, v in facts if t and at and v is not None and (at < t if strict else at <= t)]
        assert got[k] == (sum(held), len(held))


def test_nothing_known(spark, played):
    rows = entity_rows(spark.createDataFrame(played, SCHEMA))
    ask, none = rows.select("contest_id", "side", "entity_id", "cutoff"), rows.where("false")
    assert side_means(ask, none).where("for_left is null").count() == opponent_adjusted(ask, none).where("adjusted is null").count() == 2 * len(played)
    assert adjusted_form(none).count() == 0
