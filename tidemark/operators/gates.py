"""Comparisons that decide: stages on their common items, gates with two looks, answers only above cut-offs from history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
#: Ranges of values within which the ranks of distinct values run.
RANGES = 4096


def block_interval(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, blocks, delta, low, high from one row for each key and block with its sum `s` and number `n` of differences.

    The mean difference with the 95 % interval of the variance between blocks, the limit of resampling whole blocks. One block gives no interval (nulls).
    """
    mean = Window.partitionBy(*keys)
    away = sums.withColumns({"total": F.sum("s").over(mean), "all": F.sum("n").over(mean)}).withColumn("e", F.col("s") - F.col("n") * F.col("total") / F.col("all"))
    b = F.count("*")
    half = F.when(b > 1, Z * F.sqrt(F.sum(F.col("e") * F.col("e")) * b / (b - 1)) / F.first("all"))
    out = away.groupBy(*keys).agg(F.first("all").alias("n"), b.alias("blocks"), (F.first("total") / F.first("all")).alias("delta"), half.alias("half"))
    return out.select(*keys, "n", "blocks", "delta", (F.col("delta") - F.col("half")).alias("low"), (F.col("delta") + F.col("half")).alias("high"))


def paired_stages(scored: DataFrame, item: str, stage: str, stages: list, block: str, values: list[str], least_blocks: int = 3) -> DataFrame:
    """One row a stage: due (items with it), paired (items with all stages), the mean of each value over the paired items, and the first value's mean difference to the last stage.

    verdict: too_few_blocks, better (the interval lies below 0), worse, no_difference; null for the last stage itself. A value that is null makes its stage missing; of
    repeated rows of an item and stage the largest values count.
    """
    have = F.array(*[F.max(F.when(F.col(stage) == s, F.struct(*values))) for s in stages]).alias("v")
    whole = scored.where(F.col(item).isNotNull()).dropna(subset=values).groupBy(item).agg(F.min(block).alias("block"), have)
    sums = whole.withColumn("paired", F.forall("v", lambda x: x.isNotNull())).select("*", F.posexplode("v").alias("k", "x")).where("x is not null")
    last = F.get("v", len(stages) - 1)[values[0]]
    gap = F.sum(F.when(F.col("paired"), F.col("x")[values[0]] - last)).alias("s")
    by_block = sums.groupBy("k", "block").agg(F.count("*").alias("due"), F.sum(F.col("paired").cast("long")).alias("n"), gap, *[F.sum(F.when(F.col("paired"), F.col("x")[v])).alias(v) for v in values])
    means = by_block.groupBy("k").agg(F.sum("due").alias("due"), F.sum("n").alias("paired"), *[F.try_divide(F.sum(v), F.sum("n")).alias(v) for v in values])
    told = block_interval(by_block.where("n > 0").select("k", "block", "s", "n"), ["k"]).drop("n")
    verdict = F.when(F.col("blocks") < least_blocks, "too_few_blocks").when(F.col("high") < 0, "better").when(F.col("low") > 0, "worse").otherwise("no_difference")
    other = F.col("k") < len(stages) - 1
    out = means.join(told, "k", "left")
    return out.select(F.get(F.array(*[F.lit(s) for s in stages]), "k").alias(stage), "due", "paired", *values, *[F.when(other, F.col(c)).alias(c) for c in ("delta", "low", "high")], "blocks", F.when(other, verdict).alias("verdict"))


def two_looks(cells: DataFrame, keys: list[str], targets: int, interim: int, final: int) -> DataFrame:
    """keys, n, targets, status of cells (keys, n, low, high), one a target.

    withdrawn: at the interim look (n reaches `interim`) some interval lies above 0. verified: at the final look (n reaches `final`) all `targets` targets are there and
    all intervals lie below 0. Else open. n is the smallest of the targets'; a target without interval decides nothing.
    """
    lost, won = F.max(F.coalesce(F.col("low") > 0, F.lit(False))), F.sum(F.coalesce(F.col("high") < 0, F.lit(False)).cast("long"))
    seen = cells.groupBy(*keys).agg(F.min("n").alias("n"), F.count("*").alias("targets"), lost.alias("lost"), won.alias("won"))
    status = F.when((F.col("n") >= interim) & F.col("lost"), "withdrawn").when((F.col("n") >= final) & (F.col("targets") == targets) & (F.col("won") == targets), "verified").otherwise("open")
    return seen.select(*keys, "n", "targets", status.alias("status"))


def history_cuts(history: DataFrame, key: str, value: str, levels: list[float]) -> DataFrame:
    """key, cuts: for each level the value (0 to 1) from which on the most certain `level` share of the history lies, exactly, by linear interpolation between ranks.

    Ranks run over distinct values within one of 4096 ranges, ranges over their totals, so no task holds a key's whole history. A level of 1 or more cuts at 0.
    """
    each = history.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("v") * RANGES))
    ranges = each.groupBy(key, "range").agg(F.sum("n").alias("held"))
    up = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4097 rows a key
    ranges = ranges.select(key, "range", F.coalesce(F.sum("held").over(up), F.lit(0)).alias("below"), F.sum("held").over(Window.partitionBy(key)).alias("all"))
    within = Window.partitionBy(key, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumn("upto", F.sum("n").over(within)).join(ranges, [key, "range"]).withColumns({"last": F.col("below") + F.col("upto") - 1, "first": F.col("below") + F.col("upto") - F.col("n")})
    place = [(F.col("all") - 1) * F.lit(round(1 - x, 12)) for x in levels]
    at = lambda r: F.max(F.when(r.between(F.col("first"), F.col("last")), F.col("v")))
    ends = [F.struct(at(F.floor(p)).alias("a"), at(F.ceil(p)).alias("b"), F.max(p - F.floor(p)).alias("f")) for p in place]
    cuts = [F.lit(0.0) if x >= 1 else F.get("ends", i)["a"] + (F.get("ends", i)["b"] - F.get("ends", i)["a"]) * F.get("ends", i)["f"] for i, x in enumerate(levels)]
    return ranked.groupBy(key).agg(F.array(*ends).alias("ends")).select(key, F.array(*cuts).alias("cuts"))


def answered(rows: DataFrame, cuts: DataFrame, key: str, certainty: str, hit: Column, loss: Column, levels: list[float]) -> DataFrame:
    """One row for each key and level: cut, answered (rows at or above it), coverage, hits, accuracy with its Wilson interval, loss; one aggregate, no row twice."""
    at = lambda i: F.col(certainty) >= F.get("cuts", i) - 1e-12
    parts = [F.struct(F.lit(x).alias("level"), F.max(F.get("cuts", i)).alias("cut"), F.sum(F.when(at(i), 1).otherwise(0)).alias("answered"), F.sum(F.when(at(i) & hit, 1).otherwise(0)).alias("hits"), F.avg(F.when(at(i), loss)).alias("loss")) for i, x in enumerate(levels)]
    out = rows.join(cuts, key).groupBy(key).agg(F.count("*").alias("rows"), F.array(*parts).alias("parts")).select(key, "rows", F.inline("parts"))
    n, r = F.col("answered"), F.try_divide("hits", "answered")
    half = Z * F.sqrt(F.try_divide(r * (1 - r), n) + F.try_divide(F.lit(Z * Z / 4), n * n))
    side = lambda s: F.try_divide(r + F.try_divide(F.lit(Z * Z / 2), n) + s * half, 1 + F.try_divide(F.lit(Z * Z), n))
    return out.select(key, "level", "cut", "answered", (n / F.col("rows")).alias("coverage"), "hits", r.alias("accuracy"), side(-1).alias("low"), side(1).alias("high"), "loss")
