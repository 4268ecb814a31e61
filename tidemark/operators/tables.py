"""Merging, comparing and auditing whole tables by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def prefer(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """All of primary, and of secondary the rows whose key primary lacks (null keys are never found, so they stay)."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the named values as JSON, in order of name; nulls count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change: added, removed, changed or unchanged, by the hash of the other columns."""
    rest = [c for c in old.columns if c not in keys]
    a, b = old.select(*keys, row_hash(rest).alias("__old")), new.select(*keys, row_hash(rest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def common_set(scored: DataFrame, item: str, model: str) -> DataFrame:
    """The rows of items that every model of the table has scored."""
    n = scored.select(model).distinct().agg(F.count("*").alias("__n"))
    full = scored.groupBy(item).agg(F.countDistinct(model).alias("__m")).join(F.broadcast(n)).where("__m = __n").select(item)
    return scored.join(full, item, "left_semi")


def table_digest(df: DataFrame) -> DataFrame:
    """One row (digest): SHA-256 of the number of rows and of the sums of four 64-bit parts of the rows' hashes.

    Sums do not depend on the order of rows and are made in parts by every task, so no task gathers hashes; repeated rows count.
    """
    h = row_hash(df.columns)
    rows = df.select(*[F.conv(F.substring(h, 16 * k + 1, 16), 16, 10).cast("decimal(28, 0)").alias(f"h{k}") for k in range(4)])
    sums = [F.coalesce(F.sum(f"h{k}"), F.lit(0)).cast("string") for k in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *sums), 256).alias("digest"))


def table_hash(df: DataFrame) -> str:
    """The digest of `table_digest` as a string."""
    return table_digest(df).first()[0]


def ledger(held: DataFrame, incoming: DataFrame, key: str, content: list[str]) -> DataFrame:
    """incoming with status: WRITTEN (new key), UNCHANGED (same content) or CONFLICT (other content; never overwrites). Repeats in one batch go by their first content."""
    h = row_hash(content)
    old = held.select(key, h.alias("__old"))
    first = F.min(F.struct(h.alias("hash"))).over(Window.partitionBy(key)).getField("hash")
    new = incoming.withColumns({"__new": h, "__first": first, "__nth": F.row_number().over(Window.partitionBy(key).orderBy(h))})
    status = F.when(F.col("__old").isNotNull(), F.when(F.col("__old") == F.col("__new"), "UNCHANGED").otherwise("CONFLICT"))
    status = status.when(F.col("__new") != F.col("__first"), "CONFLICT").when(F.col("__nth") > 1, "UNCHANGED").otherwise("WRITTEN")
    return new.join(old, key, "left").withColumn("status", status).drop("__old", "__new", "__first", "__nth")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("rule"))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason, in order, whose condition holds; null for an accepted row."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in reasons.items()])


def unpivot_map(df: DataFrame, keys: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def tolerant_compare(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """(keys, column, left, right, status) of cells that differ by more than the tolerance, and of keys on one side."""
    x, y = (d.unpivot(keys, columns, "column", v) for d, v in ((a, "left"), (b, "right")))
    both = x.withColumn("__l", F.lit(1)).join(y.withColumn("__r", F.lit(1)), [*keys, "column"], "full_outer")
    status = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("left").eqNullSafe(F.col("right")) & ~(F.abs(F.col("left") - F.col("right")) <= tolerance), "differs")
    return both.withColumn("status", status).where("status is not null").drop("__l", "__r")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores before costly row-wise maths, if its files give fewer partitions than there are cores; large tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def once_per(df: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `build` adds to its distinct keys (null is a key): costly row-wise maths of few columns, done once for each combination of their values.

    What was built is written first, so that Spark knows its size when it joins.
    """
    built = build(spread(df.select(*keys).distinct()))
    added = [c for c in built.columns if c not in keys]
    right = written(built, "once").select(*[F.col(k).alias(f"__{k}") for k in keys], *added)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for one in same[1:]:
        on = on & one
    return df.join(right, on, "left").drop(*[f"__{k}" for k in keys])
