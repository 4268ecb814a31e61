"""Keyed multinomial fits against a full Newton solve in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import softmax
from tidemark.plans.catalog import QUERIES
from tidemark.plans.deep_plans import _windows


def solve(f, y, start, ridge):
    """f: rows x parameters x classes."""
    t, start = np.array(start, float), np.array(start, float)
    for _ in range(200):
        s = np.einsum("npc,p->nc", f, t)
        e = np.exp(s - s.max(1, keepdims=True))
        q = e / e.sum(1, keepdims=True)
        m = np.einsum("nc,npc->np", q, f)
        g = f[np.arange(len(y)), :, y].sum(0) - m.sum(0) - ridge * (t - start)
        h = np.einsum("nc,npc,nqc->pq", q, f, f) - m.T @ m + ridge * np.eye(len(t))
        step = np.linalg.solve(h, g)
        t = t + step * min(1, 2 / np.abs(step).max())
    assert np.abs(step).max() < 1e-9
    return t


def design(name, p):
    l, z, o = np.log(p), np.zeros(len(p)), np.ones(len(p))  # noqa: E741
    bias = [[z, o, z], [z, z, o]]
    if name == "temperature":
        rows = [[l[:, 0], l[:, 1], l[:, 2]]]
    elif name == "affine":
        rows = [[l[:, 0], l[:, 1], l[:, 2]], *bias]
    elif name == "vector":
        rows = [[l[:, 0], z, z], [z, l[:, 1], z], [z, z, l[:, 2]], *bias]
    else:
        rows = [*[[z, l[:, k], z] for k in range(3)], *[[z, z, l[:, k]] for k in range(3)], *bias]
    return np.array(rows).transpose(2, 0, 1)


def test_calibrators_on_the_table(spark, sf):
    rows = _windows(spark, sf).select("model_id", "p", "y", "early").toPandas()
    found = {(r.model_id, r.method): r for r in QUERIES["calibrators"](spark, sf).collect()}
    assert len(found) == 12
    for (model, name), r in found.items():
        own = rows[rows.model_id == model]
        fit, late = own[own.early], own[~own.early]
        start = softmax.CALIBRATORS[name](F.col("p"))[1]
        f = design(name, np.stack(fit.p))
        theta = solve(f, fit.y.to_numpy(), start, 1.0)
        assert r.status == "FITTED" and r.fit_n == len(fit) and r.theta == pytest.approx(theta, abs=1e-6)
        s = np.einsum("npc,p->nc", design(name, np.stack(late.p)), theta)
        q = np.exp(s) / np.exp(s).sum(1, keepdims=True)
        assert r.loss_after == pytest.approx(-np.log(q[np.arange(len(late)), late.y]).mean(), rel=1e-6)


def test_status_by_key(spark):
    rows = [("few", 0, 0.2, 0.3), ("few", 1, 0.2, 0.3)] + [("one", 0, 0.4, 0.3)] * 200 + [("ok", k % 3, 0.2 + 0.01 * (k % 30), 0.3) for k in range(200)] + [("ok", None, 0.2, 0.3), ("ok", 1, None, 0.3)]
    df = spark.createDataFrame(rows, "k string, y int, a double, b double").withColumn("p", F.when(F.col("a").isNotNull(), F.array("a", "b", 1 - F.col("a") - F.col("b"))))
    features, start = softmax.affine(F.col("p"))
    found = {r.k: r for r in softmax.fit(df, ["k"], F.col("y"), features, start, 1.0).collect()}
    assert {k: r.status for k, r in found.items()} == {"few": "TOO_FEW_ROWS", "one": "ONE_CLASS", "ok": "FITTED"}
    assert found["few"].theta == start and found["ok"].n == 200 and found["ok"].theta != start


def test_pooled_offsets_are_the_joint_minimum(spark):
    rng = np.random.default_rng(2)
    pools, rows = ["a", "b", "c"], []
    for k in range(450):
        pool = pools[k % 3 if k < 400 else 0]
        p = rng.dirichlet([2, 2, 2])
        shift = {"a": [0, 0.6, 0], "b": [0, -0.5, 0.3], "c": [0, 0, 0]}[pool]
        q = p**1.3 * np.exp(shift)
        rows.append((pool, int(rng.choice(3, p=q / q.sum())), [float(x) for x in p]))
    theta, offsets = softmax.fit_pooled(spark.createDataFrame(rows, "pool string, y int, p array<double>"), "pool", F.col("y"), F.col("p"), ridge=100.0)
    p, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    f = design("affine", p)
    extra = np.zeros((len(rows), 6, 3))
    for i, r in enumerate(rows):
        j = pools.index(r[0])
        extra[i, 2 * j, 1] = extra[i, 2 * j + 1, 2] = 1
    t = solve(np.concatenate([f, extra], axis=1), y, [1.0] + [0.0] * 8, np.array([1e-6] * 3 + [100.0] * 6))
    assert theta.first()["theta"] == pytest.approx(t[:3], abs=2e-4)
    found = {r.pool: r.theta for r in offsets.collect()}
    for j, pool in enumerate(pools):
        assert found[pool] == pytest.approx(t[3 + 2 * j : 5 + 2 * j], abs=2e-4)


def test_stacking_by_pool(spark, sf):
    found = QUERIES["stacking"](spark, sf).collect()
    assert found and all(len(r.theta) == 4 and r.status == "FITTED" for r in found)
