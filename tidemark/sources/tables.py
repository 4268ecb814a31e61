"""Readers of the driver's tables and the derived views (contests, entity rows, quotes, forecasts) that the queries run on.

Timestamps of the files carry no zone; readers make them instants in UTC. Every view has a twin in SQL text, used as a common table
expression by the checking queries, so both sides derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def seconds(c: str | Column) -> Column:
    """Whole seconds since 1970 of an instant."""
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event between a left and a right entity, known three hours after it."""
    events = read_table(spark, sf_dir, "events")
    n = events.agg(F.max("user_id") + 1).first()[0] or 2
    e = events.select("event_id", "user_id", "event_type", "ts", "value")
    return e.select(
        F.col("event_id").alias("contest_id"), F.col("ts").alias("event_ts"), F.col("user_id").alias("left_id"),
        ((F.col("user_id") + 1 + F.col("event_id") % (n - 1)) % n).alias("right_id"), F.col("event_type").alias("pool"),
        F.date_trunc("week", "ts").alias("season"), (F.floor("value").cast("long") % 5).alias("left_n"), ((F.col("event_id") * 7 + 3) % 4).alias("right_n"),
        (F.col("ts") + F.expr("interval 3 hours")).alias("available_at"),
    )


CONTESTS = """contests as (
    select event_id as contest_id, ts as event_ts, user_id as left_id, (user_id + 1 + event_id % ((select max(user_id) + 1 from events) - 1)) % (select max(user_id) + 1 from events) as right_id,
        event_type as pool, date_trunc('week', ts) as season, cast(floor(value) as bigint) % 5 as left_n, (event_id * 7 + 3) % 4 as right_n, ts + interval 3 hour as available_at
    from events)"""


def outcome(left: str | Column = "left_n", right: str | Column = "right_n") -> Column:
    """0 if the left side has more, 1 for equal counts, 2 otherwise; null if a count is missing."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    return F.when(a > b, 0).when(a == b, 1).when(a < b, 2)


def entity_rows(c: DataFrame) -> DataFrame:
    """Each contest as its left and its right entity see it."""
    side = lambda s, own, opp, a, b: F.struct(F.lit(s).alias("side"), F.col(own).alias("entity_id"), F.col(opp).alias("opp_id"), F.col(a).alias("own_n"), F.col(b).alias("opp_n"))
    both = F.array(side("L", "left_id", "right_id", "left_n", "right_n"), side("R", "right_id", "left_id", "right_n", "left_n"))
    rows = c.select("contest_id", "pool", "season", "event_ts", "available_at", (F.col("event_ts") - F.expr("interval 90 minutes")).alias("cutoff"), F.explode(both).alias("v"))
    points = F.when(F.col("own_n") > F.col("opp_n"), 3).when(F.col("own_n") == F.col("opp_n"), 1).otherwise(0).cast("long")
    return rows.select("contest_id", "pool", "season", "event_ts", "available_at", "cutoff", "v.*").withColumn("pts", points)


ENTITY = """entity_rows as (
    select contest_id, pool, season, event_ts, available_at, event_ts - interval 90 minute as cutoff, side, entity_id, opp_id, own_n, opp_n,
        cast(case when own_n > opp_n then 3 when own_n = opp_n then 1 else 0 end as bigint) as pts
    from (select *, 'L' as side, left_id as entity_id, right_id as opp_id, left_n as own_n, right_n as opp_n from contests
        union all select *, 'R', right_id, left_id, right_n, left_n from contests))"""


#: Rows of prices that one task numbers, about; what it holds does not grow with the table.
QUOTE_ROWS = 250_000


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of three outcomes by five makers; the files have no key, so rows are numbered over all columns."""
    from pyspark.sql import Window

    l = read_table(spark, sf_dir, "lineitem")  # noqa: E741
    tasks = l.count() // QUOTE_ROWS
    if tasks > 1:  # a set number, as merged tasks would each sort a share of the table
        l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax").repartition(tasks, "l_orderkey")  # noqa: E741
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    return l.select(
        F.col("l_orderkey").alias("contest"), (F.col("l_suppkey") % 5).alias("maker"), (F.col("l_linenumber") % 3).cast("long").alias("outcome"),
        (F.lit(1.05) + (F.col("l_partkey") % 400) / F.lit(100.0)).cast("double").alias("price"), F.col("l_shipdate").cast("timestamp").alias("observed_at"), seq.alias("seq"),
    )


QUOTES = """quotes as (
    select l_orderkey as contest, l_suppkey % 5 as maker, cast(l_linenumber % 3 as bigint) as outcome, cast(1.05 as double) + (l_partkey % 400) / cast(100 as double) as price,
        cast(l_shipdate as timestamp) as observed_at,
        row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) as seq
    from lineitem)"""


def forecasts(c: DataFrame) -> DataFrame:
    """A probability vector for each contest, made 90 minutes before it, with the outcome y."""
    a, b, d = (F.lit(1) + F.col("contest_id") % k for k in (7, 5, 6))
    total = (a + b + d).cast("double")
    return c.select("contest_id", "pool", "season", "event_ts", "available_at", (F.col("event_ts") - F.expr("interval 90 minutes")).alias("cutoff"), (a / total).alias("p0"), (b / total).alias("p1"), (d / total).alias("p2"), outcome().alias("y"))


FORECASTS = """forecasts as (
    select contest_id, pool, season, event_ts, available_at, event_ts - interval 90 minute as cutoff,
        (1 + contest_id % 7) / cast(3 + contest_id % 7 + contest_id % 5 + contest_id % 6 as double) as p0,
        (1 + contest_id % 5) / cast(3 + contest_id % 7 + contest_id % 5 + contest_id % 6 as double) as p1,
        (1 + contest_id % 6) / cast(3 + contest_id % 7 + contest_id % 5 + contest_id % 6 as double) as p2,
        case when left_n > right_n then 0 when left_n = right_n then 1 else 2 end as y
    from contests)"""


def models(f: DataFrame) -> DataFrame:
    """Three models' vectors for each contest; the third abstains now and then."""
    i = F.col("contest_id")
    weights = {1: (7, 5, 6), 2: (5, 8, 3), 3: (4, 9, 11)}
    vectors = F.array(*[F.struct(F.lit(m).alias("model_id"), *[(F.lit(1.0) + i % k).alias(f"w{n}") for n, k in enumerate(ks)]) for m, ks in weights.items()])
    rows = f.select("contest_id", "pool", "season", "event_ts", "cutoff", "y", F.explode(vectors).alias("m")).select("contest_id", "pool", "season", "event_ts", "cutoff", "y", "m.*")
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return rows.where((F.col("model_id") != 3) | (i % 11 != 0)).withColumns({f"p{n}": F.col(f"w{n}") / total for n in range(3)}).drop("w0", "w1", "w2")


MODELS = """models as (
    select contest_id, pool, season, event_ts, cutoff, y, model_id, w0 / (w0 + w1 + w2) as p0, w1 / (w0 + w1 + w2) as p1, w2 / (w0 + w1 + w2) as p2 from (
        select *, 1 as model_id, cast(1 + contest_id % 7 as double) as w0, cast(1 + contest_id % 5 as double) as w1, cast(1 + contest_id % 6 as double) as w2 from forecasts
        union all select *, 2, cast(1 + contest_id % 5 as double), cast(1 + contest_id % 8 as double), cast(1 + contest_id % 3 as double) from forecasts
        union all select *, 3, cast(1 + contest_id % 4 as double), cast(1 + contest_id % 9 as double), cast(1 + contest_id % 11 as double) from forecasts where contest_id % 11 <> 0))"""
