"""Drift between a reference and a current sample, by key, without collecting either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psi(rows: DataFrame, key: str, value: str, is_reference: Column, bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(key, psi): population stability over the reference's quantile bins; shares under `floor` count as it. Values are counted first, so windows run over distinct ones."""
    marked = rows.select(key, F.col(value).alias("__v"), is_reference.alias("__ref")).where("__v is not null")
    counted = marked.groupBy(key, "__v").agg(F.sum(F.col("__ref").cast("long")).alias("a"), F.sum((~F.col("__ref")).cast("long")).alias("b"))
    upto = F.sum("a").over(Window.partitionBy(key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"upto": upto, "total": F.sum("a").over(Window.partitionBy(key))})
    edges = []
    for i in range(1, bins):  # between the values at the two places around the quantile
        at = F.lit(i / bins) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") > f(at), F.col("__v"))) for f in (F.floor, F.ceil))
        edges.append(low + (high - low) * (F.max(at) - F.floor(F.max(at))))
    edges = placed.groupBy(key).agg(F.array(*edges).alias("edges"), F.max("total").alias("total")).where("total > 0").drop("total")
    binned = counted.join(edges, key).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("__v"))))
    counts = binned.groupBy(key, "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(key)
    p, q = (F.greatest(F.col(c) / F.sum(c).over(w), F.lit(floor)) for c in ("a", "b"))
    all_bins = edges.select(key, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts, [key, "bin"], "left").fillna(0, ["a", "b"])
    return all_bins.withColumns({"p": p, "q": q}).groupBy(key).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def jensen_shannon(rows: DataFrame, key: str, category: str, is_reference: Column, least: int = 1) -> DataFrame:
    """(key, js, status): base-2 divergence of category shares; INSUFFICIENT_DATA with fewer than `least` rows on a side."""
    counts = rows.groupBy(key, category).agg(F.sum(is_reference.cast("long")).alias("a"), F.sum((~is_reference).cast("long")).alias("b"))
    w = Window.partitionBy(key)
    s = counts.withColumns({"na": F.sum("a").over(w), "nb": F.sum("b").over(w)}).withColumns({"p": F.try_divide("a", "na"), "q": F.try_divide("b", "nb")})
    m = (F.col("p") + F.col("q")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    out = s.groupBy(key).agg((F.sum(term("p") + term("q")) / 2).alias("js"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    enough = (F.col("na") >= least) & (F.col("nb") >= least)
    return out.select(key, F.when(enough, F.col("js")).alias("js"), F.when(enough, "OK").otherwise("INSUFFICIENT_DATA").alias("status"))


def kolmogorov_smirnov(rows: DataFrame, key: str, value: str, is_reference: Column) -> DataFrame:
    """(key, ks): largest distance of the two distribution functions; values are counted first, so the window runs over distinct ones."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("__v")).agg(F.sum(is_reference.cast("long")).alias("a"), F.sum((~is_reference).cast("long")).alias("b"))
    run, whole = Window.partitionBy(key).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(key)
    gap = F.abs(F.try_divide(F.sum("a").over(run), F.sum("a").over(whole)) - F.try_divide(F.sum("b").over(run), F.sum("b").over(whole)))
    return counts.withColumn("gap", gap).groupBy(key).agg(F.max("gap").alias("ks"))
