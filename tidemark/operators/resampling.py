"""Resampling with hash-seeded draws: aggregate to blocks first, then draw blocks, so the work is blocks x draws, not rows x draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_bootstrap(rows: DataFrame, block: str, values: list[str], draws: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(value, mean, low, high, share_below_zero) of the mean of each value under resampling of whole blocks. Rows with a null value count for the others."""
    sums = rows.groupBy(block).agg(*[F.sum(v).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"n_{v}") for v in values])
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy(block)) - 1)
    k = numbered.count()
    spark = rows.sparkSession
    picks = spark.range(draws).withColumnRenamed("id", "draw").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max(1, k))))).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "draw", "j"), F.lit(max(1, k))).cast("int"))
    drawn = picks.join(numbered, "i").groupBy("draw").agg(*[(F.sum(f"s_{v}") / F.sum(f"n_{v}")).alias(v) for v in values])
    tail = (1 - level) / 2
    long = drawn.unpivot("draw", values, "value", "m")
    spread = long.groupBy("value").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.avg((F.col("m") < 0).cast("int")).alias("share_below_zero"))
    point = sums.agg(*[(F.sum(f"s_{v}") / F.sum(f"n_{v}")).alias(v) for v in values]).withColumn("k", F.lit(0)).unpivot("k", values, "value", "mean").drop("k")
    return point.join(spread, "value")


#: Parts that the distinct values are dealt to, so that a draw is made by many tasks.
PARTS = 32


def _counted(rows: DataFrame, value: str, label: str | None = None) -> DataFrame:
    """(part, v, n, k): the rows of each distinct value, and those of them that the label holds."""
    kept = rows.select(F.col(value).cast("double").alias("v"), (F.lit(False) if label is None else F.col(label)).alias("g")).dropna()
    return kept.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.col("g").cast("long")).alias("k")).withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))


def poisson_bootstrap(rows: DataFrame, value: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """(draw, mean): the mean of rows that each weigh Poisson(1). The n rows of one value weigh Poisson(n) together, so the work is values times draws, not rows times draws."""

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("v")
        n, v = cells["n"].to_numpy(), cells["v"].to_numpy()
        out = []
        for draw in range(draws):
            w = np.random.default_rng([seed, draw, int(key[0])]).poisson(n)
            out.append((draw, float(w @ v), int(w.sum())))
        return pd.DataFrame(out, columns=["draw", "s", "w"])

    parts = _counted(rows, value).groupBy("part").applyInPandas(run, "draw long, s double, w long")
    return parts.groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))


def bootstrap_interval(rows: DataFrame, value: str, draws: int = 500, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(n, mean, low, high): percentile interval of the mean under row weights."""
    tail = (1 - level) / 2
    spread = poisson_bootstrap(rows, value, draws, seed).agg(F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))
    return rows.agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean")).crossJoin(spread)


def holm(hypotheses: DataFrame, p: str, ids: list[str], alpha: float = 0.05) -> DataFrame:
    """hypotheses with passes: each p in ascending order must be at most alpha / (those left), and all before it pass. One row a hypothesis, so one task."""
    order = Window.orderBy(p, *ids)
    n = F.count("*").over(Window.partitionBy())
    ok = F.col(p) <= alpha / (n - F.row_number().over(order) + 1)
    return hypotheses.withColumn("__ok", ok).withColumn("passes", F.min("__ok").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__ok")


#: Rows that numpy's hypergeometric draws can tell apart.
MOST_ROWS = 10**9


def permutation_p(rows: DataFrame, value: str, group: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """(gap, p): the difference of means between rows where `group` holds and the others, and how often a relabelling gives one as large.

    A relabelling gives the rows of a value a hypergeometric number of labels. The labels are first dealt to parts of the values, alike in every task, then within each
    part to its values: together that is an exact draw, at values times draws. Ties count as large (to 12 digits). Null where one side is empty; up to 10^9 rows.
    """
    cells = _counted(rows, value, group)
    sums = cells.groupBy("part").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.col("k") * F.col("v")).alias("t")).orderBy("part").collect()
    n, k = sum(r["n"] for r in sums), sum(r["k"] for r in sums)
    if not 0 < k < n:
        return rows.sparkSession.createDataFrame([(None, None)], "gap double, p double")
    if n >= MOST_ROWS:
        raise ValueError(f"{n} rows; exact relabelling holds for fewer than {MOST_ROWS}")
    whole, own = sum(r["s"] for r in sums), sum(r["t"] for r in sums)
    names, sizes = [r["part"] for r in sums], np.array([r["n"] for r in sums])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("v")
        count, v, place = part["n"].to_numpy(), part["v"].to_numpy(), names.index(key[0])
        out = []
        for draw in range(draws):
            mine = np.random.default_rng([seed, draw]).multivariate_hypergeometric(sizes, k, method="marginals")[place]
            out.append((draw, float(np.random.default_rng([seed, draw, int(key[0]) + 1]).multivariate_hypergeometric(count, mine, method="marginals") @ v)))
        return pd.DataFrame(out, columns=["draw", "t"])

    gap = lambda t: t / k - (whole - t) / (n - k)
    null = cells.groupBy("part").applyInPandas(run, "draw long, t double").groupBy("draw").agg(F.sum("t").alias("t"))
    seen = float(gap(own))
    as_large = F.sum((F.abs(gap(F.col("t"))) >= abs(seen) * (1 - 1e-12)).cast("int"))
    return null.agg(F.lit(seen).alias("gap"), ((as_large + 1) / (F.count("*") + 1)).alias("p"))
