"""Penalised rates against a full Newton solve in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ridge_rates as ridge
from tidemark.plans import rating_plans
from tidemark.plans.catalog import QUERIES
from tidemark.sources.tables import contests


def solve(rows, groups, pen=ridge.RIDGE, prior=None):
    """All parameters of one model at once: attack, defence (as distances from level + term, term), terms, level, edge."""
    prior = prior or {}
    entities = sorted({e for r in rows for e in r[:2]})
    names = sorted(set(groups.values()))
    n, m = len(entities), len(names)
    at, gt = {e: i for i, e in enumerate(entities)}, {g: i for i, g in enumerate(names)}
    # theta: u (attack less mean), v (defence less mean), attack terms, defence terms, level, edge
    size = 2 * n + 2 * m + 2
    lam = np.concatenate([np.full(n, pen["attack"]), np.full(n, pen["defence"]), np.full(m, pen["attack_group"]), np.full(m, pen["defence_group"]), [0.0, pen["edge"]]])
    x, y, w, off = [], [], [], []
    for l, r, a, b, neutral, weight in rows:  # noqa: E741
        for own, opp, k, e in ((l, r, a, 0.5 if neutral else 1.0), (r, l, b, 0.5 if neutral else 0.0)):
            row = np.zeros(size)
            row[at[own]] += 1
            row[n + at[opp]] -= 1
            row[2 * n + gt[groups[own]]] += 1
            row[2 * n + m + gt[groups[opp]]] -= 1
            row[-2], row[-1] = 1, e
            x.append(row)
            y.append(k)
            w.append(weight)
            off.append(prior.get(own, 0.0) + prior.get(opp, 0.0))
    x, y, w, off = map(np.array, (x, y, w, off))
    t = np.zeros(size)
    t[-2] = np.log((w * y).sum() / w.sum())
    for _ in range(100):
        rate = w * np.exp(x @ t + off)
        g = x.T @ (rate - w * y) + lam * t
        step = np.linalg.solve((x * rate[:, None]).T @ x + np.diag(lam), g)
        t = t - step * min(1, 2 / max(np.abs(step).max(), 1e-9))
    assert np.abs(g).max() < 1e-9
    attack = {e: t[i] + t[2 * n + gt[groups[e]]] + t[-2] + prior.get(e, 0.0) for e, i in at.items()}
    defence = {e: t[n + i] + t[2 * n + m + gt[groups[e]]] - prior.get(e, 0.0) for e, i in at.items()}
    rate = np.exp(x @ t + off)
    over = (w * ((y - rate) ** 2 - rate)).sum() / (w * rate**2).sum()
    return attack, defence, t[-2], t[-1], max(0.0, over)


def compare(p, levels, wanted, model):
    attack, defence, level, edge, over = wanted
    found = {r.entity: r for r in p.where(F.col("model") == model).collect()}
    assert set(found) == set(attack)
    for e in attack:
        assert found[e].attack == pytest.approx(attack[e], abs=1e-5) and found[e].defence == pytest.approx(defence[e], abs=1e-5)
    (l,) = levels.where(F.col("model") == model).collect()  # noqa: E741
    assert (l.level, l.edge, l.dispersion) == pytest.approx((level, edge, over), abs=1e-5)
    assert l.gradient < 1e-4


def test_query_is_the_minimum_in_every_pool(spark, sf):
    rows = contests(spark, sf).select("pool", "left_id", "right_id", "left_n", "right_n", rating_plans.neutral().alias("neutral")).collect()
    found = QUERIES["ridge_rates"](spark, sf).withColumnRenamed("pool", "model").cache()
    for pool in sorted({r.pool for r in rows})[:2]:
        own = [(r.left_id, r.right_id, r.left_n, r.right_n, r.neutral, 1.0) for r in rows if r.pool == pool]
        groups = {e: str(e % rating_plans.GROUPS) for r in own for e in r[:2]}
        attack, defence, level, edge, _ = solve(own, groups)
        got = {r.entity: r for r in found.where(F.col("model") == pool).collect()}
        assert set(got) == set(attack)
        for e in attack:
            assert (got[e].attack, got[e].defence, got[e].level, got[e].edge) == pytest.approx((attack[e], defence[e], level, edge), abs=1e-5)


def test_weights_priors_neutral_and_several_models(spark):
    rng = np.random.default_rng(4)
    rows = []
    for model in ("m1", "m2"):
        for _ in range(60):
            l, r = rng.choice(6, 2, replace=False)  # noqa: E741
            rows.append((model, f"e{l}", f"e{r}", int(rng.poisson(1.8)), int(rng.poisson(1.1)), bool(rng.random() < 0.2), float(rng.random() + 0.2)))
    rows.append(("m1", "e0", "e1", None, None, False, 1.0))
    rows.append(("m3", "x", "y", 2, 0, False, 1.0))
    df = spark.createDataFrame(rows, "model string, l string, r string, a int, b int, neutral boolean, w double")
    prior = {"e0": 0.3, "e5": -0.2}
    p, levels = ridge.fit(df, "l", "r", "a", "b", F.col("model"), F.when(F.col("entity") < "e3", "low").otherwise("high"), F.col("neutral"), F.col("w"), spark.createDataFrame(list(prior.items()), "entity string, prior double"))
    p, levels = p.cache(), levels.cache()
    groups = {**{f"e{k}": "low" if k < 3 else "high" for k in range(6)}, "x": "high", "y": "high"}
    for model in ("m1", "m2", "m3"):
        compare(p, levels, solve([r[1:] for r in rows if r[0] == model and r[3] is not None], groups, prior=prior), model)
    told = ridge.expected(df.select("model", "l", "r", "neutral").union(spark.createDataFrame([("m1", "new", "e1", False), ("m9", "a", "b", False)], "model string, l string, r string, neutral boolean")), p, levels, "model", "l", "r", F.col("neutral")).collect()
    new = next(r for r in told if r.l == "new")
    one = {r.entity: r for r in p.where("model = 'm1'").collect()}
    (level,) = levels.where("model = 'm1'").collect()
    assert new.left_rate == pytest.approx(np.exp(level.level - one["e1"].defence + level.edge)) and next(r for r in told if r.model == "m9").left_rate is None


def test_cells_meet_both_sides_once(spark, monkeypatch):
    """Level, edge and gradient come from the entities' sums, so only the last levels join both sides to the cells; before, each sweep and each look at the gradient did."""
    from tidemark.operators import ridge_rates

    calls, kept = [], ridge_rates._sides
    monkeypatch.setattr(ridge_rates, "_sides", lambda *a: calls.append(1) or kept(*a))
    rows = spark.createDataFrame([("m", i % 5, (i + 1 + i // 5) % 5, i % 4, (i * 3) % 3) for i in range(60) if i % 5 != (i + 1 + i // 5) % 5], "model string, l long, r long, a long, b long")
    _, levels = ridge_rates.fit(rows, "l", "r", "a", "b", F.col("model"))
    found = levels.first()
    assert len(calls) == 1 and found.gradient < 1e-6
