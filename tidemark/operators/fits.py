"""Fits as grouped aggregates: one pass over the rows a step, parameters a small table written between steps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def frequencies(rows: DataFrame, pool: str, y: str, classes: int = 3, weight: float = 50.0) -> DataFrame:
    """(pool, q0..): outcome shares of each pool drawn to the overall shares as by `weight` rows."""
    each = [F.sum((F.col(y) == k).cast("double")).alias(f"n{k}") for k in range(classes)]
    overall = rows.agg(F.count(y).alias("n"), *each).select(*[(F.col(f"n{k}") / F.col("n")).alias(f"g{k}") for k in range(classes)])
    pools = rows.groupBy(pool).agg(F.count(y).alias("n"), *each).join(F.broadcast(overall))
    return pools.select(pool, *[((F.col(f"n{k}") + weight * F.col(f"g{k}")) / (F.col("n") + weight)).alias(f"q{k}") for k in range(classes)])


def logistic(rows: DataFrame, features: list[Column], y: Column, steps: int = 12, ridge: float = 1e-6) -> list[float]:
    """Intercept and slopes by Newton steps; each step is one aggregate of the gradient and the Hessian over rows that are written once."""
    x = [F.lit(1.0), *features]
    k = len(x)
    base = rows.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(x)], y.cast("double").alias("y")).dropna()
    base = written(base, "logistic-rows")
    beta = np.zeros(k)
    for _ in range(steps):
        eta = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        p = base.withColumn("p", 1 / (1 + F.exp(-eta)))
        w = F.col("p") * (1 - F.col("p"))
        sums = p.agg(*[F.sum(F.col(f"x{i}") * (F.col("y") - F.col("p"))) for i in range(k)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}") * w) for i in range(k) for j in range(k)]).first()
        g, h = np.array(sums[:k], float) - ridge * beta, np.array(sums[k:], float).reshape(k, k) + ridge * np.eye(k)
        step = np.linalg.solve(h, g)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta.tolist()


def rates(rows: DataFrame, left: str, right: str, left_n: str, right_n: str, sweeps: int = 8, shrink: float = 5.0, weight: Column | None = None) -> tuple[float, float, DataFrame]:
    """Log-linear Poisson rates by iterative scaling: (level of the left side, of the right, table entity, attack, defence).

    A sweep joins the parameters to the rows, sums by entity and updates; `shrink` pseudo-counts draw an entity to the mean.
    """
    w = F.lit(1.0) if weight is None else weight
    c = rows.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(left_n).alias("ln"), F.col(right_n).alias("rn"), w.alias("w")).dropna()
    n, a, b = c.agg(F.sum("w"), F.sum(F.col("w") * F.col("ln")), F.sum(F.col("w") * F.col("rn"))).first()
    home, away = (a or 0.0) / (n or 1.0), (b or 0.0) / (n or 1.0)
    sides = c.select(F.explode(F.array(F.struct(F.col("l").alias("own"), F.col("r").alias("opp"), F.col("ln").alias("k"), F.lit(home).alias("level"), "w"), F.struct(F.col("r").alias("own"), F.col("l").alias("opp"), F.col("rn").alias("k"), F.lit(away).alias("level"), "w"))).alias("s")).select("s.*")
    sides = written(sides.groupBy("own", "opp", "level").agg(F.sum(F.col("w") * F.col("k")).alias("k"), F.sum("w").alias("w")), "rate-cells")
    params = sides.select(F.col("own").alias("entity")).union(sides.select("opp")).distinct().select("entity", F.lit(1.0).alias("attack"), F.lit(1.0).alias("defence"))
    for i in range(sweeps):
        d = sides.join(params.select(F.col("entity").alias("opp"), "defence"), "opp")
        attack = d.groupBy(F.col("own").alias("entity")).agg(((F.sum("k") + shrink) / (F.sum(F.col("w") * F.col("level") * F.col("defence")) + shrink)).alias("attack"))
        d = sides.join(attack.select(F.col("entity").alias("own"), "attack"), "own")
        defence = d.groupBy(F.col("opp").alias("entity")).agg(((F.sum("k") + shrink) / (F.sum(F.col("w") * F.col("level") * F.col("attack")) + shrink)).alias("defence"))
        params = written(params.select("entity").join(attack, "entity", "left").join(defence, "entity", "left").fillna(1.0), f"rates-{i}")
    return home, away, params


def low_score_rho(rows: DataFrame, x: str, y: str, left_n: str, right_n: str, rounds: int = 3) -> float:
    """The dependence of low scores of greatest likelihood: a grid of values summed in one aggregate, then refined twice."""
    low, high = -0.2, 0.2
    cells = rows.where((F.col(left_n) <= 1) & (F.col(right_n) <= 1))
    for _ in range(rounds):
        grid = [low + (high - low) * i / 10 for i in range(11)]

        def tau(r: float) -> Column:
            h, a, u, v = F.col(left_n), F.col(right_n), F.col(x), F.col(y)
            return F.when((h == 0) & (a == 0), 1 - u * v * r).when((h == 0) & (a == 1), 1 + u * r).when((h == 1) & (a == 0), 1 + v * r).otherwise(1 - r)

        sums = cells.agg(*[F.sum(F.log(F.greatest(tau(r), F.lit(1e-9)))) for r in grid]).first()
        best = max(range(11), key=lambda i: sums[i] if sums[i] is not None else -math.inf)
        step = (high - low) / 10
        low, high = grid[best] - step, grid[best] + step
    return (low + high) / 2


def elo(rows: DataFrame, pool: str, at: str, known_at: str, key: str, left: str, right: str, y: str, k: float = 20.0, edge: float = 60.0) -> DataFrame:
    """rows with the ratings of both entities before each contest, from the results known by its time: contests that start together never see each other.

    A result moves both ratings once it is known, by what the ratings before its contest said; a contest without one is rated and moves nothing. Pools are independent; a pool is replayed in
    order by one task, which holds its entities' ratings and the results that are not known yet.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"{pool} {kind(pool)}, {key} {kind(key)}, left_rating double, right_rating double"

    def run(batches):
        import heapq

        import pandas as pd

        held, waiting, now = {}, [], object()
        for pdf in batches:
            a, b = [], []
            for p, t, known, n, i, j, o in zip(pdf[pool], pdf[at], pdf[known_at], pdf[key], pdf[left], pdf[right], pdf[y]):
                if p != now:
                    held, waiting, now = {}, [], p
                while waiting and waiting[0][0] <= t:
                    _, _, x, z, move = heapq.heappop(waiting)
                    held[x], held[z] = held.get(x, 1500.0) + move, held.get(z, 1500.0) - move
                u, v = held.get(i, 1500.0), held.get(j, 1500.0)
                a.append(u)
                b.append(v)
                expected = 1 / (1 + 10 ** (-(u + edge - v) / 400))
                if not (pd.isna(o) or pd.isna(known)):
                    heapq.heappush(waiting, (known, n, i, j, k * ((1.0, 0.5, 0.0)[int(o)] - expected)))
            yield pd.DataFrame({pool: pdf[pool], key: pdf[key], "left_rating": a, "right_rating": b})

    ordered = rows.select(pool, at, known_at, key, left, right, y).dropna(subset=[pool, at, key, left, right]).repartition(pool).sortWithinPartitions(pool, at, key)
    return ordered.mapInPandas(run, schema)


def best_of_grid(rows: DataFrame, losses: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, name, loss): the candidate of least mean loss in each group; ties go by name. All candidates in one aggregate."""
    sums = rows.groupBy(*by).agg(*[F.avg(c).alias(n) for n, c in losses.items()])
    long = sums.unpivot(by, list(losses), "name", "loss")
    return long.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("loss", "name"))).where("__n = 1").drop("__n")
