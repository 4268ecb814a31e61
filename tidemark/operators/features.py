"""Running values of a key's history, to be attached at a cutoff by an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict) -> DataFrame:
    """Adds name -> (function, column, last n rows or None for all, least rows): null where fewer rows than `least` stand so far."""
    base = Window.partitionBy(*keys).orderBy(*order)
    out = {}
    for name, (f, column, n, least) in values.items():
        w = base.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)
        value = f(F.col(column)).over(w)
        out[name] = value if least <= 1 else F.when(F.count(F.lit(1)).over(w) >= least, value)
    return rows.withColumns(out)


def usual_members(sets: DataFrame, entity: str, day: str, key: str, members: str, last: int = 5, most: int = 11) -> DataFrame:
    """entity, key, sets_n, usual, missing_n: the `most` members that stand in most of an entity's last sets known before the day, and how many of them this set lacks.

    A set is known the day after its own, so sets of one day never see each other; the `last` newest known ones count (of one day, those with the largest keys). Ties of
    members go by the member. usual and missing_n are null until `last` sets are known. Arrays hold the members of `last` days' sets at most.
    """
    days = sets.groupBy(entity, day).agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.array_distinct(members).alias("m"))), asc=False), 1, last).alias("own"))
    before = Window.partitionBy(entity).orderBy(day).rowsBetween(-last, -1)
    days = days.withColumn("held", F.slice(F.flatten(F.reverse(F.collect_list("own").over(before))), 1, last)).withColumn("held", F.transform("held", lambda s: s.m)).select(entity, day, "held")
    every = F.array_distinct(F.flatten("held"))
    ranked = F.array_sort(F.transform(every, lambda m: F.struct((-F.size(F.filter("held", lambda s: F.array_contains(s, m)))).alias("n"), m.alias("m"))))
    usual = F.when(F.size("held") == last, F.transform(F.slice(ranked, 1, most), lambda r: r.m))
    out = sets.join(days, [entity, day]).withColumn("usual", usual)
    return out.select(entity, key, F.size("held").cast("long").alias("sets_n"), "usual", F.size(F.array_except("usual", members)).cast("long").alias("missing_n"))
