"""Suggestions, usual sets and exact resampling against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import resampling, suggest
from tidemark.operators.features import usual_members
from tidemark.plans.catalog import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_every_similar_name_is_found(spark, least):
    rng = random.Random(3)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["aaaaaaa", "abababab", "ünïcode", "x"]

    def torn(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        return "".join(w)

    known, names = sorted({w for w in base}), sorted({torn(w) for w in base * 2} | {""})
    left = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    right = spark.createDataFrame([(n,) for n in known] + [(None,), ("",)], "other string")
    found = {(r.name, r.other) for r in suggest.similar_names(left, right, "name", "other", least).collect()}
    wanted = {(a, b) for a in names for b in known if a and b and 1 - distance(a, b) / max(len(a), len(b)) >= least - 1e-12}
    assert found == wanted and wanted
    best = suggest.suggestions(left, right, "name", "other", least, 2).collect()
    assert not {r.name for r in best} & set(known) and max(Counter(r.name for r in best).values()) <= 2


def test_usual_members(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(1, 12), k, [rng.randint(0, 9) for _ in range(rng.randint(0, 5))]) for k in range(60)]
    df = spark.createDataFrame(rows, "e string, day int, k int, m array<int>")
    found = {r.k: r for r in usual_members(df, "e", "day", "k", "m", last=3, most=4).collect()}
    for e, day, k, m in rows:
        held = sorted(((d, j, set(x)) for f, d, j, x in rows if f == e and d < day), key=lambda t: (-t[0], -t[1]))[:3]
        n = Counter(x for _, _, s in held for x in s)
        usual = sorted(n, key=lambda x: (-n[x], x))[:4] if len(held) == 3 else None
        assert found[k].sets_n == len(held) and found[k].usual == usual
        assert found[k].missing_n == (None if usual is None else len([x for x in usual if x not in m]))


def test_relabelling_is_exact_in_law(spark):
    rng = np.random.default_rng(5)
    v, g = rng.integers(0, 4, 80), rng.random(80) < 0.4
    v = v + g * rng.integers(0, 2, 80)
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(v, g)] + [(None, True), (1.0, None)], "v double, g boolean")
    (found,) = resampling.permutation_p(df, "v", "g", draws=2000).collect()
    gap = v[g].mean() - v[~g].mean()
    assert found.gap == pytest.approx(gap)
    null = []
    for _ in range(4000):
        h = rng.permutation(g)
        null.append(abs(v[h].mean() - v[~h].mean()) >= abs(gap) * (1 - 1e-12))
    assert abs(found.p - np.mean(null)) < 4 * np.sqrt(max(found.p, 0.01) / 2000) + 0.005
    assert resampling.permutation_p(df.where("g"), "v", "g").first().p is None


def test_row_bootstrap(spark, sf):
    rng = np.random.default_rng(6)
    x = rng.exponential(2, 300).round(1)
    df = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "x double")
    (found,) = resampling.bootstrap_interval(df, "x", draws=1000).collect()
    means = [rng.choice(x, len(x)).mean() for _ in range(2000)]
    assert (found.n, found.mean) == (300, pytest.approx(x.mean()))
    se = np.std(means)
    assert abs(found.low - np.quantile(means, 0.025)) < 0.35 * se and abs(found.high - np.quantile(means, 0.975)) < 0.35 * se
    (q,) = QUERIES["row_bootstrap"](spark, sf).collect()
    assert q.low < q.mean < q.high


@pytest.mark.parametrize("family, shape", [("poisson", 0.0), ("negative_binomial", 3.5), ("bivariate", 0.25), ("bivariate", 0.0001)])
def test_family_cells(spark, family, shape):
    """Cells against sums of draws' probabilities, with the mass that they hold."""
    from math import exp, factorial, gamma

    from pyspark.sql import functions as F

    from tidemark.functions import grids

    l, r, most = 1.7, 1.1, 6  # noqa: E741
    po = lambda x, k: exp(-x) * x**k / factorial(k)
    nb = lambda x, k: gamma(shape + k) / gamma(shape) / factorial(k) * (shape / (shape + x)) ** shape * (x / (shape + x)) ** k
    c3 = shape * min(l, r)
    two = lambda h, a: sum(po(c3, c) * po(l - c3, h - c) * po(r - c3, a - c) for c in range(min(h, a) + 1))
    cell = {"poisson": lambda h, a: po(l, h) * po(r, a), "negative_binomial": lambda h, a: nb(l, h) * nb(r, a), "bivariate": two}[family]
    wanted = np.array([[cell(h, a) for a in range(most + 1)] for h in range(most + 1)])
    g = spark.range(1).select(grids.family_cells(family, F.lit(l), F.lit(r), F.lit(shape), most).alias("g")).first().g
    assert np.allclose(np.array(g.cells), wanted / wanted.sum(), rtol=1e-10)
    assert g.captured == pytest.approx(wanted.sum(), rel=1e-10) and g.tail == pytest.approx(1 - wanted.sum(), abs=1e-12)
    with pytest.raises(ValueError):
        grids.family_cells("other", F.lit(l), F.lit(r), F.lit(1.0))
