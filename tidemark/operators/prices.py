"""Price and probability columns: implied probabilities, margin removal, triples at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(values: dict[str, Column], body) -> Column:
    """body(row) with the named values computed once a row; a lambda would compute what it names for each element."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), 0)


def implied(prices: Column) -> Column:
    """1 / price of each outcome."""
    return F.transform(prices, lambda p: F.lit(1.0) / p)


def overround(prices: Column) -> Column:
    return total(implied(prices)) - 1


def remove_margin(prices: Column, method: str = "normalization", steps: int = 60) -> Column:
    """Probabilities that sum to one. power: the exponent k with sum(q ** k) = 1; shin: Shin's share of informed money z; both by bisection."""
    if method not in ("normalization", "power", "shin"):
        raise ValueError(f"unknown method {method}")
    scaled = lambda a: let({"a": a, "s": total(a)}, lambda v: F.transform(v.a, lambda x: x / v.s))
    q = implied(prices)
    if method == "normalization":
        return scaled(q)

    def solve(v: Column) -> Column:
        if method == "power":
            low, high, at = 0.01, 20.0, lambda k: F.transform(v.q, lambda x: F.pow(x, k))
        else:
            low, high, at = 0.0, 0.9, lambda z: F.transform(v.q, lambda x: (F.sqrt(z * z + 4 * (1 - z) * x * x / v.s) - z) / (2 * (1 - z)))

        def halve(s: Column, _: Column) -> Column:
            mid = (s.lo + s.hi) / 2
            step = {"mid": mid, "above": total(at(mid)) > 1}
            return let(step | {"lo": s.lo, "hi": s.hi}, lambda w: F.struct(F.when(w.above, w.mid).otherwise(w.lo).alias("lo"), F.when(w.above, w.hi).otherwise(w.mid).alias("hi")))

        start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s.lo + s.hi) / 2)
        fair = let({"k": found}, lambda w: scaled(at(w.k)))
        return fair if method == "power" else F.when(v.s <= 1, scaled(v.q)).otherwise(fair)

    return let({"q": q, "s": total(q)}, solve)


def triples_at(quotes: DataFrame, asks: DataFrame, max_age: int, max_spread: int) -> DataFrame:
    """The last price of each outcome by contest and maker seen in the `max_age` seconds up to the asked time; complete triples seen within `max_spread` seconds."""
    seen = quotes.join(asks, "contest").where((F.col("observed_at") <= F.col("at")) & (F.unix_seconds("observed_at") >= F.unix_seconds("at") - max_age))
    rank = F.struct("observed_at", "seq")
    cells = [F.max_by(F.when(F.col("outcome") == k, F.col("price")), F.when(F.col("outcome") == k, rank)).alias(f"p{k}") for k in range(3)]
    times = [F.max(F.when(F.col("outcome") == k, F.unix_seconds("observed_at"))).alias(f"t{k}") for k in range(3)]
    out = seen.groupBy("contest", "maker").agg(*cells, *times).where("t0 is not null and t1 is not null and t2 is not null")
    return out.withColumn("spread", F.greatest("t0", "t1", "t2") - F.least("t0", "t1", "t2")).where(F.col("spread") <= max_spread).drop("t0", "t1", "t2")
