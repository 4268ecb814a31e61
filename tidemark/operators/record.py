"""What published forecasts were worth: the last one before the start against the base rate and the market, and results kept with when they were first seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_before(published: DataFrame, item: str, made_at: str, start: str, tie: str) -> DataFrame:
    """For each item the row made last, strictly before its start; of one time, the one with the largest `tie`. Items with later rows only are no forecasts and go."""
    rest = F.struct(*[c for c in published.columns if c != item])
    held = published.where(F.col(item).isNotNull() & (F.col(made_at) < F.col(start)))
    return held.groupBy(item).agg(F.max_by(rest, F.struct(made_at, tie)).alias("row")).select(item, "row.*")


def base_rates(results: DataFrame, outcome: str, known_at: str, first_made: DataFrame, classes: int = 3) -> DataFrame:
    """One row, base: the shares of the outcomes known when the first forecast was made (first_made: one row, first_at); of all outcomes if none was known then."""
    n = results.where(F.col(outcome).isNotNull()).groupBy(outcome, known_at).agg(F.count("*").alias("n")).join(F.broadcast(first_made))  # one row
    early = F.coalesce(F.col(known_at) <= F.col("first_at"), F.lit(False))
    count = lambda k, c: F.coalesce(F.sum(F.when((F.col(outcome) == k) & c, F.col("n"))), F.lit(0))
    sums = n.agg(F.array(*[count(k, early) for k in range(classes)]).alias("early"), F.array(*[count(k, F.lit(True)) for k in range(classes)]).alias("every"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    used = F.when(total("early") > 0, F.col("early")).otherwise(F.col("every"))
    return sums.select(used.alias("used")).select(F.transform("used", lambda x: F.try_divide(x, total("used"))).alias("base"))


def upsert_results(held: DataFrame, seen: DataFrame, key: str, values: list[str], void: list[str]) -> DataFrame:
    """held (key, values, status, first_seen) with seen (key, values, status, seen_at): the newest seen row of a key replaces its values, the earliest time stays as first_seen.

    action: new, changed, same or kept (not seen again); is_void marks a status of `void`, whose values are null, so that it is no result. Ties of time go by the values and the status.
    """
    names = [*values, "status"]
    valued = lambda d: d.withColumns({v: F.when(~F.coalesce(F.col("status").isin(void), F.lit(False)), F.col(v)) for v in values})
    fact = F.struct(*names)
    new = valued(seen).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(fact, F.struct("seen_at", *names)).alias("new"), F.min("seen_at").alias("seen"))
    old = valued(held).select(key, fact.alias("old"), "first_seen")
    both = old.join(new, key, "full_outer")
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    out = both.select(key, F.coalesce("new", "old").alias("fact"), F.least("first_seen", "seen").alias("first_seen"), action.alias("action"))
    return out.select(key, *[F.col(f"fact.{c}").alias(c) for c in names], "first_seen", "action", F.coalesce(F.col("fact.status").isin(void), F.lit(False)).alias("is_void"))


def pending(due: DataFrame, results: DataFrame, key: str, start: str, now, grace_hours: int) -> DataFrame:
    """Rows of due that began over `grace_hours` before `now` and have no row in results, with hours_late after the grace."""
    late = due.where(F.col(start) + F.make_interval(hours=F.lit(grace_hours)) < now).join(results.select(key), key, "left_anti")
    return late.withColumn("hours_late", (F.unix_seconds(now) - F.unix_seconds(start)) / 3600.0 - grace_hours)
