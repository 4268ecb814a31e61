"""Published forecasts and results on small tables: late rows, ties, nulls, void results, nothing at all."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.record import base_rates, last_before, pending, upsert_results

T = datetime(2024, 1, 1)
H = timedelta(hours=1)


def test_last_before_the_start(spark):
    rows = [(1, T - H, T, 1), (1, T - 2 * H, T, 9), (1, T, T, 5), (2, T - H, T, 3), (2, T - H, T, 7), (3, T + H, T, 1), (4, None, T, 1), (None, T - H, T, 1)]
    df = spark.createDataFrame(rows, "item long, made timestamp, start timestamp, v long")
    assert sorted((r.item, r.v) for r in last_before(df, "item", "made", "start", "v").collect()) == [(1, 1), (2, 7)]
    assert last_before(df.where("false"), "item", "made", "start", "v").count() == 0


@pytest.mark.parametrize("first, want", [(T + H, [1.0, 0.0, 0.0]), (T - H, [0.5, 0.25, 0.25])])
def test_base_rates(spark, first, want):
    results = spark.createDataFrame([(0, T), (0, T + 2 * H), (1, T + 3 * H), (2, None), (None, T)], "y int, at timestamp")
    assert base_rates(results, "y", "at", spark.createDataFrame([(first,)], "first_at timestamp")).first().base == want


def test_base_rates_of_nothing(spark):
    none = spark.createDataFrame([], "y int, at timestamp")
    assert base_rates(none, "y", "at", spark.createDataFrame([(None,)], "first_at timestamp")).first().base == [None] * 3


RESULT = "k long, a long, status string, first_seen timestamp"


def test_upsert(spark):
    held = spark.createDataFrame([(1, 5, "final", T), (2, 5, "final", T), (3, 5, "final", T + 9 * H), (4, 5, "final", T)], RESULT)
    seen = [(1, 5, "final", T + H), (2, 6, "final", T + H), (2, 7, "final", T + 2 * H), (3, 5, "void", T + H), (5, 1, "final", T + H), (5, 1, "final", T + H), (6, None, None, T), (None, 1, "final", T)]
    out = upsert_results(held, spark.createDataFrame(seen, "k long, a long, status string, seen_at timestamp"), "k", ["a"], ["void"])
    got = {r.k: (r.a, r.status, r.h, r.action, r.is_void) for r in out.withColumn("h", ((F.unix_seconds("first_seen") - F.unix_seconds(F.lit(T))) / 3600).cast("int")).collect()}
    assert got == {
        1: (5, "final", 0, "same", False), 2: (7, "final", 0, "changed", False), 3: (None, "void", 1, "changed", True), 4: (5, "final", 0, "kept", False),
        5: (1, "final", 1, "new", False), 6: (None, None, 0, "new", False),
    }
    again = upsert_results(out.select("k", "a", "status", "first_seen"), spark.createDataFrame([], "k long, a long, status string, seen_at timestamp"), "k", ["a"], ["void"])
    assert {r.action for r in again.collect()} == {"kept"} and again.count() == 6


def test_pending(spark):
    due = spark.createDataFrame([(1, T), (2, T), (3, T + 20 * H), (4, None)], "k long, start timestamp")
    got = pending(due, spark.createDataFrame([(1, 5, "final", T)], RESULT), "k", "start", F.lit(T + 10 * H), 6).collect()
    assert [(r.k, r.hours_late) for r in got] == [(2, 4.0)]
