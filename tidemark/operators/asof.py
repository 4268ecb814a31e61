"""As-of joins: what was known about a key at a decision time.

The state side and the asking side are united and one window carries the last state forward, so a key is shuffled once and no pair of
rows is made that the join then drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_state(state: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """One row for each key and time: the last by the tie columns."""
    w = Window.partitionBy(*keys, at).orderBy(*[F.col(c).desc() for c in tie])
    return state.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def as_of(asking: DataFrame, state: DataFrame, keys: list[str], ask_at: str, known_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """asking with the values of the last state row of its key known at (strict: before) its time; nulls where there is none.

    state must hold one row for each key and time (see `last_state`). A row whose key or time is null finds nothing. The time of the row
    found comes as `<known_at>`.
    """
    names = asking.columns
    ask = asking.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(ask_at).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).alias("__state"))
    packed = F.struct(F.col(known_at), *[F.col(v) for v in values])
    known = state.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(known_at).alias("__t"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(ask.schema["__row"].dataType).alias("__row"), packed.alias("__state"))
    known = known.where(F.col("__t").isNotNull())
    both = ask.withColumn("__state", F.lit(None).cast(known.schema["__state"].dataType)).unionByName(known)
    order = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__state", ignorenulls=True).over(order)).where(F.col("__row").isNotNull())
    usable = F.col("__t").isNotNull()
    for i in range(len(keys)):
        usable = usable & F.col(f"__k{i}").isNotNull()
    return carried.select("__row.*", *[F.when(usable, F.col(f"__last.{v}")).alias(v) for v in [known_at, *values]])


def as_of_window(asking: DataFrame, facts: DataFrame, keys: list[str], ask_at: str, known_at: str, length: int, aggregates: dict) -> DataFrame:
    """asking with aggregates of the facts of its key known in the `length` seconds up to its time (both ends included).

    aggregates: name -> (function, column of facts), the function one of Spark's that skip nulls.
    """
    columns = sorted({c for _, c in aggregates.values()})
    names = asking.columns
    ask = asking.select(*keys, F.unix_seconds(ask_at).alias("__t"), F.struct(*names).alias("__row"))
    known = facts.select(*keys, F.unix_seconds(known_at).alias("__t"), *[F.col(c).alias(f"__v_{c}") for c in columns])
    both = ask.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__t").rangeBetween(-length, 0)
    out = both.withColumns({n: f(F.col(f"__v_{c}")).over(w) for n, (f, c) in aggregates.items()})
    return out.where(F.col("__row").isNotNull()).select("__row.*", *aggregates)


def nearest(asking: DataFrame, facts: DataFrame, keys: list[str], ask_day: str, fact_day: str, days: int, fact_id: str) -> DataFrame:
    """asking joined with the fact of its key on the same day, else the nearest within `days`; ties: the earlier day, then the smaller id.

    Facts go into buckets of days + 1 days and each asking row looks into three of them, so the join is by equality.
    """
    size = days + 1
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / size)
    a = asking.withColumn("__id", F.monotonically_increasing_id()).withColumn("__b", F.explode(F.sequence(number(ask_day) - 1, number(ask_day) + 1)))
    f = facts.withColumn("__b", number(fact_day))
    gap = F.datediff(F.col(fact_day), F.col(ask_day))
    pairs = a.join(f, [*keys, "__b"]).where(F.abs(gap) <= days).withColumn("day_gap", gap)
    best = pairs.withColumn("__n", F.row_number().over(Window.partitionBy("__id").orderBy(F.abs("day_gap"), "day_gap", fact_id))).where("__n = 1")
    return best.drop("__n", "__id", "__b")
