"""Multinomial logits by Newton steps, many models at once: one aggregate a step over all keys, each key's small system solved beside its sums.

Equal rows are counted once and enter every step with their number as a weight. A row's score of class c is base_c + sum over p of theta_p f_pc; calibrators and stacking differ only in their features f. A penalty draws theta to where it starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import written

#: One feature: its value for each class, None for zero.
Feature = Sequence[Column | float | None]
#: A Newton step moves no parameter by more than this.
REACH = 4.0


def _named(features: Sequence[Feature]) -> tuple[list[list[Column | None]], list[Column]]:
    """The features over columns `f_p_c`, and those columns; constants stay constants."""
    table: list[list[Column | None]] = []
    held: list[Column] = []
    for p, f in enumerate(features):
        row: list[Column | None] = []
        for c, x in enumerate(f):
            if isinstance(x, Column):
                held.append(x.cast("double").alias(f"f_{p}_{c}"))
                row.append(F.col(f"f_{p}_{c}"))
            else:
                row.append(None if not x else F.lit(float(x)))
        table.append(row)
    return table, held


def scores(features: Sequence[Feature], theta: Column, base: Column | None = None) -> list[Column]:
    out = []
    for c in range(len(features[0])):
        s = F.lit(0.0) if base is None else F.get(base, c)
        for p, f in enumerate(features):
            if f[c] is not None and not (isinstance(f[c], float) and f[c] == 0.0):
                s = s + F.get(theta, p) * f[c]
        out.append(s)
    return out


def probabilities(features: Sequence[Feature], theta: Column, base: Column | None = None) -> Column:
    """The vector of class probabilities; the largest score is taken out first."""
    s = F.array(*scores(features, theta, base))
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def fit(rows: DataFrame, keys: list[str], y: Column, features: Sequence[Feature], start: list[float], ridge: list[float] | float = 1e-6, base: Column | None = None, steps: int = 25,
        least_rows: int = 100, tolerance: float = 1e-9, weight: Column | None = None) -> DataFrame:
    """keys, theta, n (the sum of the whole-number weights, 1 a row if none), status: FITTED, TOO_FEW_ROWS or ONE_CLASS (some class does not occur); what is not fitted stays at `start`. Rows with a null label or feature are left out."""
    n_p, n_c = len(features), len(features[0])
    penalty, at = np.broadcast_to(np.asarray(ridge, float), n_p).copy(), np.asarray(start, float)
    table, held = _named(features)
    data = rows.select(*keys, y.cast("int").alias("y_"), *held, *([] if base is None else [base.alias("base_")]), (F.lit(1) if weight is None else weight).cast("long").alias("w_")).dropna(subset=["y_", *[f"f_{p}_{c}" for p, f in enumerate(features) for c, x in enumerate(f) if isinstance(x, Column)]])
    data = written(data.groupBy(*[c for c in data.columns if c != "w_"]).agg(F.sum("w_").alias("w_")), "softmax-rows")  # equal rows are one with a weight
    count = data.groupBy(*keys).agg(F.sum("w_").alias("n"), *[F.sum(F.when(F.col("y_") == c, F.col("w_")).otherwise(0)).alias(f"n{c}") for c in range(n_c)])
    status = F.when(F.col("n") < least_rows, "TOO_FEW_ROWS").when(F.least(*[F.col(f"n{c}") for c in range(n_c)]) == 0, "ONE_CLASS").otherwise("FITTED")
    state = written(count.select(*keys, "n", status.alias("status"), F.array(*[F.lit(float(x)) for x in at]).alias("theta")), "softmax")
    pairs = [(p, q) for p in range(n_p) for q in range(p, n_p)]
    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + ["theta array<double>", "moved double"])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            theta, moved = [], []
            for t, g, h in zip(f["theta"], f["g"], f["h"]):
                t, m = np.array(t), np.zeros((n_p, n_p))
                for (p, q), x in zip(pairs, h):
                    m[p, q] = m[q, p] = x
                step = np.linalg.lstsq(m + np.diag(penalty), np.array(g) - penalty * (t - at), rcond=None)[0]
                step *= min(1.0, REACH / max(np.abs(step).max(), 1e-300))
                theta.append((t + step).tolist())
                moved.append(float(np.abs(step).max()))
            yield pd.DataFrame({**{k: f[k] for k in keys}, "theta": theta, "moved": moved})

    add = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0.0)
    for k in range(steps):
        open_ = state.where("status = 'FITTED'").select(*keys, "theta")
        at_rows = data.join(open_, keys) if keys else data.crossJoin(open_)
        at_rows = at_rows.withColumn("p_", probabilities(table, F.col("theta"), None if base is None else F.col("base_")))
        mean = {f"m{p}": add([F.get("p_", c) * x for c, x in enumerate(f) if x is not None]) for p, f in enumerate(table)}
        at_rows = at_rows.withColumns(mean)
        own = [F.sum(F.col("w_") * (add([F.when(F.col("y_") == c, x).otherwise(0.0) for c, x in enumerate(f) if x is not None]) - F.col(f"m{p}"))) for p, f in enumerate(table)]
        curve = [F.sum(F.col("w_") * (add([F.get("p_", c) * x * z for c, (x, z) in enumerate(zip(table[p], table[q])) if x is not None and z is not None]) - F.col(f"m{p}") * F.col(f"m{q}"))) for p, q in pairs]
        sums = at_rows.groupBy(*keys).agg(F.first("theta").alias("theta"), F.array(*own).alias("g"), F.array(*curve).alias("h"))
        new = written(sums.mapInPandas(solve, schema), "softmax-step")
        parts = state.drop("theta").join(new, keys, "left") if keys else state.drop("theta").crossJoin(new)
        state = parts.withColumn("theta", F.coalesce("theta", F.array(*[F.lit(float(x)) for x in at])))
        if k > 1 and new.where(F.col("moved") > tolerance).isEmpty():
            break
        state = state.drop("moved")
    return state.select(*keys, "theta", "n", "status")


def logs(p: Column, classes: int = 3) -> list[Column]:
    x = [F.get(p, c) for c in range(classes)]
    return [F.when(v.isNotNull(), F.log(F.greatest(v, F.lit(1e-12)))) for v in x]  # null stays null


def temperature(p: Column) -> tuple[list[Feature], list[float]]:
    """One slope of the logs."""
    return [logs(p)], [1.0]


def affine(p: Column) -> tuple[list[Feature], list[float]]:
    """One slope, and a bias for every class but the first."""
    return [logs(p), [None, 1.0, None], [None, None, 1.0]], [1.0, 0.0, 0.0]


def vector(p: Column) -> tuple[list[Feature], list[float]]:
    """A slope of its own for each class, and biases."""
    a, b, c = logs(p)
    return [[a, None, None], [None, b, None], [None, None, c], [None, 1.0, None], [None, None, 1.0]], [1.0, 1.0, 1.0, 0.0, 0.0]


def dirichlet(p: Column) -> tuple[list[Feature], list[float]]:
    """Every class's score from all logs, against the first class; and biases."""
    a, b, c = logs(p)
    second, third = [[None, x, None] for x in (a, b, c)], [[None, None, x] for x in (a, b, c)]
    return [*second, *third, [None, 1.0, None], [None, None, 1.0]], [-1.0, 1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0]


CALIBRATORS = {"temperature": temperature, "affine": affine, "vector": vector, "dirichlet": dirichlet}


def stack(models: Sequence[Column]) -> tuple[list[Feature], list[float]]:
    """A weight for each model's logs, and biases: the log-linear pool of their vectors, each model starting with an equal share."""
    return [*[logs(p) for p in models], [None, 1.0, None], [None, None, 1.0]], [*([1 / len(models)] * len(models)), 0.0, 0.0]


def fit_pooled(rows: DataFrame, pool: str, y: Column, p: Column, ridge: float = 50.0, rounds: int = 15, least_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(theta of one affine calibrator of all rows, offsets by pool): biases of each pool drawn to zero by `ridge` a pool and class; pools and common part take turns, one Newton step each.

    A pool's offsets come from its rows alone, so the pools are fitted in one aggregate whatever their number.
    """
    kept = written(rows.select(pool, y.cast("int").alias("y"), p.alias("p")).dropna(), "pooled-rows")
    features, start = affine(F.col("p"))
    bias = [[None, 1.0, None], [None, None, 1.0]]
    theta, offsets = fit(kept, [], F.col("y"), features, start, least_rows=least_rows), None
    for _ in range(rounds):
        one = kept.crossJoin(theta.select(F.col("theta").alias("common")))
        base = F.array(*scores(features, F.col("common")))
        if offsets is not None:
            one = one.join(offsets.select(pool, F.col("theta").alias("own")), pool)
        first = [0.0, 0.0]
        offsets = fit(one, [pool], F.col("y"), bias, first, ridge, base, steps=6, least_rows=1)
        # the common part beside the pools' present biases
        beside = kept.join(offsets.select(pool, F.col("theta").alias("own")), pool)
        before = theta.first()["theta"]
        theta = fit(beside, [], F.col("y"), features, start, 1e-6, F.array(F.lit(0.0), F.get("own", 0), F.get("own", 1)), steps=6, least_rows=least_rows)
        if np.abs(np.array(theta.first()["theta"]) - np.array(before)).max() < 1e-5:
            break
    return theta, offsets
