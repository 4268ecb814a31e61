"""Stateful streams over several micro-batches: timers, moved events, changes across batches, prices that meet over batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tidemark.plans.catalog import ORACLES, QUERIES
from tidemark.plans.stream_plans import run_once
from tidemark.streaming import stateful

T0 = datetime(2024, 3, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def files(spark, tmp_path, schema, batches):
    """A stream of one file a batch, in order."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
        for f in tmp_path.glob("*.parquet"):
            if f.stat().st_mtime > 2e9 or not f.name.startswith("done"):
                new = tmp_path / f"done-{k:03d}.parquet"
                f.rename(new)
                os.utime(new, (time.time() - 1000 + k, time.time() - 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "done*.parquet").parquet(str(tmp_path))


@pytest.mark.parametrize("name", ["stream_stages", "stream_states", "stream_consensus"])
def test_twins_have_rows(duck, name):
    assert len(duck.sql(ORACLES[name]).limit(5).fetchall()) == 5 and name in QUERIES


def test_stages_over_batches(spark, tmp_path):
    stateful.state_store(spark)
    start, later = at(100), at(160)
    batches = [
        [("a", at(0), start, 1.0), ("b", at(0), start, None), ("c", at(1), start, 5.0)],
        [("a", at(50), None, 2.0), ("a", at(75), None, 3.0), ("c", at(60), later, 6.0)],  # the event of c moves
        [("a", at(95), None, 4.0), ("z", at(130), at(500), 0.0)],
        [("c", at(140), None, 7.0), ("z", at(200), at(500), 0.0)],
        [("a", at(201), None, 9.0), ("z", at(400), at(500), 1.0)],
    ]
    s = files(spark, tmp_path, "key string, at timestamp, event_at timestamp, value double", batches)
    found = {(r.key, r.stage): r for r in run_once(stateful.freeze_stages(s, "key", "at", "event_at", "value", {"early": 90, "late": 20}, "10 minutes"), "stages").collect()}
    assert len(found) == 6, sorted(found)  # z's early stage is at 410, beyond the watermark
    assert (found["a", "early"].status, found["a", "early"].value) == ("FROZEN", 1.0)
    assert (found["a", "late"].value, found["a", "late"].facts) == (3.0, 3)
    assert found["b", "early"].status == found["b", "late"].status == "EMPTY" and found["b", "late"].value is None
    assert (found["c", "early"].value, found["c", "early"].cutoff) in ((5.0, at(10)), (6.0, at(70)))
    assert (found["c", "late"].value, found["c", "late"].cutoff, found["c", "late"].moved) == (7.0, at(140), 1)
    assert found["a", "late"].late_minutes >= 0


def test_states_tell_changes_across_batches(spark, tmp_path):
    stateful.state_store(spark)
    row = lambda t, status, total, reported=None, event=None: ("k", at(t), T0, status, total, reported, event)
    batches = [[row(1, "IN_PLAY", 0), row(2, "IN_PLAY", 0)], [row(3, "IN_PLAY", 0), row(7, "IN_PLAY", 0)], [row(8, "IN_PLAY", 1, None, 30), row(9, "IN_PLAY", 1, 44)], [row(50, "IN_PLAY", 1), row(130, "IN_PLAY", 1), row(131, "FINISHED", 1)]]
    s = files(spark, tmp_path, "key string, at timestamp, start_at timestamp, status string, total long, reported int, event_minute int", batches)
    found = sorted(run_once(stateful.changed_states(s, "key"), "states").collect(), key=lambda r: r["at"])
    assert [(r.minute, r.minute_source, r.total, r.forecastable) for r in found] == [(1, "clock", 0, True), (7, "clock", 0, True), (30, "last_event", 1, True), (44, "reported", 1, True), (45, "clock", 1, True), (115, "clock", 1, False), (None, None, 1, False)]
    assert [r.polls for r in found] == [1, 4, 5, 6, 7, 8, 9]


def test_triples_meet_over_batches(spark, tmp_path):
    stateful.state_store(spark)
    q = lambda maker, k, price, stated, seen: (1, maker, k, price, at(stated), at(seen))
    batches = [
        [q("m", 0, 2.0, 0, 1), q("m", 1, 3.0, 2, 3), q("n", 0, 2.0, 0, 1), q("n", 1, 1.0, 0, 1)],
        [q("m", 2, 4.0, 4, 5), q("n", 2, 3.0, 5, 6), q("m", 0, 9.0, -5, 7)],  # a price stated earlier does not replace a newer one
        [q("m", 0, 2.5, 30, 31)],  # the others are now too old beside it
        [q("x", 0, 2.0, 5000, 5000)],
    ]
    s = files(spark, tmp_path, "contest int, maker string, outcome int, price double, stated_at timestamp, seen_at timestamp", batches)
    found = run_once(stateful.quote_triples(s, "10 minutes"), "triples").collect()
    assert sorted((r.maker, r["at"], r.a, r.b, r.c) for r in found) == [("m", at(5), 2.0, 3.0, 4.0), ("m", at(7), 2.0, 3.0, 4.0)]


def test_keys_share_lots(spark, tmp_path):
    """Many keys to a lot give what a lot for each key gives, keys of no value included; before, each key had a call and four timers of its own."""
    stateful.state_store(spark)
    key = lambda i: None if i == 7 else i
    facts = [[(key(i), at(i % 50 + 60 * b), at(100 + i) if b != 1 or i % 3 else None, float(i + b)) for i in range(40) for _ in range(1 + i % 3)] for b in range(3)] + [[(99, at(400), at(900), 0.0)]]
    polls = [[(key(i), at(20 * b + i % 7), T0, "IN_PLAY" if i % 5 else "FINISHED", (i + b) % 2, i if i % 4 == 0 else None, 30 + b if i % 3 else None) for i in range(40)] for b in range(3)]
    found = []
    for lots in (1, 4096):
        (tmp_path / f"f{lots}").mkdir(), (tmp_path / f"p{lots}").mkdir()
        s = files(spark, tmp_path / f"f{lots}", "key long, at timestamp, event_at timestamp, value double", facts)
        p = files(spark, tmp_path / f"p{lots}", "key long, at timestamp, start_at timestamp, status string, total long, reported int, event_minute int", polls)
        frozen = run_once(stateful.freeze_stages(s, "key", "at", "event_at", "value", {"early": 90, "late": 20}, "10 minutes", lots), "stages").drop("late_minutes", "missed")
        found.append([sorted(map(repr, d.collect())) for d in (frozen, run_once(stateful.changed_states(p, "key", lots=lots), "states"))])
    assert found[0] == found[1] and len(found[0][0]) == 80 and len(found[0][1]) >= 40
