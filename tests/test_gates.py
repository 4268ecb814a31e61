"""Cut-offs against numpy, looks case by case, stages on their common items."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.gates import answered, block_interval, history_cuts, paired_stages, two_looks

LEVELS = [1.0, 0.8, 0.6, 0.4, 0.1]


def test_cuts_are_numpy_quantiles(spark):
    rng = random.Random(2)
    held = {"one": [0.5], "ties": [0.25] * 40 + [0.75] * 3, "many": [rng.random() for _ in range(701)], "ends": [0.0, 1.0, 1.0, 0.0, 0.3], "near": [0.5 + k * 1e-7 for k in range(50)]}
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("many", None), ("none", None)]
    got = {r.key: r.cuts for r in history_cuts(spark.createDataFrame(rows, "key string, v double"), "key", "v", LEVELS).collect()}
    assert set(got) == set(held)
    for k, vs in held.items():
        want = [0.0 if x >= 1 else float(np.quantile(vs, round(1 - x, 12))) for x in LEVELS]
        assert got[k] == pytest.approx(want, abs=1e-12)


def test_answers_above_the_cuts(spark):
    rows = spark.createDataFrame([("a", 0.9, 1, 0.1), ("a", 0.6, 0, 0.9), ("a", 0.6, 1, 0.4), ("b", 0.2, 0, 2.0)], "key string, sure double, hit int, loss double")
    cuts = spark.createDataFrame([("a", [0.0, 0.6, 0.7]), ("b", [0.0, 0.6, 0.7])], "key string, cuts array<double>")
    got = {(r.key, r.level): r for r in answered(rows, cuts, "key", "sure", F.col("hit") == 1, F.col("loss"), [1.0, 0.5, 0.2]).collect()}
    assert [got["a", x].answered for x in (1.0, 0.5, 0.2)] == [3, 3, 1]
    assert got["a", 0.5].accuracy == pytest.approx(2 / 3) and got["a", 0.2].loss == pytest.approx(0.1)
    n, r, z = 3, 2 / 3, 1.96
    mid, half = r + z * z / 2 / n, z * math.sqrt(r * (1 - r) / n + z * z / 4 / n / n)
    assert (got["a", 1.0].low, got["a", 1.0].high) == pytest.approx(((mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)))
    assert got["b", 0.5].answered == 0 and got["b", 0.5].accuracy is None and got["b", 0.5].loss is None
    assert answered(rows.where("false"), cuts, "key", "sure", F.col("hit") == 1, F.col("loss"), [1.0]).count() == 0


def test_looks(spark):
    cells = {
        "early": [(50, 0.1, 0.2), (50, 0.1, 0.2)], "worse": [(120, 0.01, 0.2), (120, -0.3, -0.1)], "waiting": [(120, -0.2, -0.1), (120, -0.3, -0.1)],
        "better": [(300, -0.2, -0.1), (310, -0.3, -0.1)], "half": [(300, -0.2, 0.1), (310, -0.3, -0.1)], "missing": [(400, -0.2, -0.1)], "unknown": [(400, None, None), (400, -0.2, -0.1)],
    }
    rows = [(k, *c) for k, cs in cells.items() for c in cs]
    got = {r.key: (r.n, r.status) for r in two_looks(spark.createDataFrame(rows, "key string, n long, low double, high double"), ["key"], 2, 100, 300).collect()}
    assert got == {"early": (50, "open"), "worse": (120, "withdrawn"), "waiting": (120, "open"), "better": (300, "verified"), "half": (300, "open"), "missing": (400, "open"), "unknown": (400, "open")}


def test_interval_agrees_with_resampled_blocks(spark):
    rng = np.random.default_rng(1)
    n = rng.integers(20, 60, 80)
    s = n * rng.normal(0.02, 0.05, 80)
    r = block_interval(spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(s, n)] + [("one", 1.0, 4)], "key string, s double, n long"), ["key"]).collect()
    r = {x.key: x for x in r}
    draw = rng.integers(0, 80, (20000, 80))
    means = s[draw].sum(1) / n[draw].sum(1)
    assert r["k"].delta == pytest.approx(s.sum() / n.sum())
    assert (r["k"].low, r["k"].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1.5e-3)
    assert (r["one"].delta, r["one"].blocks, r["one"].low) == (0.25, 1, None)


def test_stages_on_common_items(spark):
    rows = [
        (i, s, f"w{i % 4}", loss) for i in range(40) for s, loss in (("early", 1.0 + i % 3 / 10), ("late", 0.5 + i % 2 / 10), ("last", 0.6 + i % 2 / 10)) if not (s == "early" and i % 5 == 0)
    ] + [(99, "late", "w1", None), (None, "late", "w1", 3.0), (7, "other", "w1", 9.0)]
    stages = ["early", "late", "last"]
    got = {r.stage: r for r in paired_stages(spark.createDataFrame(rows, "item long, stage string, week string, loss double"), "item", "stage", stages, "week", ["loss"]).collect()}
    common = [i for i in range(40) if i % 5]
    assert {s: (r.due, r.paired) for s, r in got.items()} == {"early": (32, 32), "late": (40, 32), "last": (40, 32)}
    assert got["early"].loss == pytest.approx(sum(1.0 + i % 3 / 10 for i in common) / 32)
    assert got["late"].delta == pytest.approx(-0.1) and got["late"].verdict == "better" and got["early"].verdict == "worse"
    assert got["last"].delta is None and got["last"].verdict is None and got["last"].blocks == 4
    none = spark.createDataFrame([(1, "early", "w", 1.0)], "item long, stage string, week string, loss double")
    (only,) = paired_stages(none, "item", "stage", stages, "week", ["loss"]).collect()
    assert (only.due, only.paired, only.loss, only.delta) == (1, 0, None, None)
