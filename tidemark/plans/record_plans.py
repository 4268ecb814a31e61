"""The track record of published forecasts, and results with what is still pending."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators.record import base_rates, last_before, pending, upsert_results
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _BRIER, _LOSS, _M, _RPS, _TRIPLE, _triples
from tidemark.sources.tables import CONTESTS, contests, forecasts, models, outcome

query = Registry()
_MADE = "(contest_id % 4 + model_id - 4) * 40"
_PICK = "case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end"
_OF = "-ln(least(greatest(case y when 0 then {0} when 1 then {1} else {2} end, 1e-15), 1 - 1e-15))"
_W = "1.96 * sqrt(hits / cast(n as double) * (1 - hits / cast(n as double)) / n + 0.9604 / n / n)"


@query(f"""{_M}, {_TRIPLE}, market as (select contest as contest_id, avg(1 / a / (1 / a + 1 / b + 1 / c)) as m0, avg(1 / b / (1 / a + 1 / b + 1 / c)) as m1, avg(1 / c / (1 / a + 1 / b + 1 / c)) as m2 from t group by 1),
published as (select *, event_ts + to_minutes({_MADE}) as made_at from models),
chosen as (select * from published where made_at < event_ts qualify row_number() over (partition by contest_id order by made_at desc, model_id desc) = 1),
o as (select available_at, case when left_n > right_n then 0 when left_n = right_n then 1 else 2 end as y from contests),
early as (select y from o where available_at <= (select min(made_at) from published)), used as (select y from early union all select y from o where not exists (select * from early)),
base as (select avg(cast(y = 0 as int)) as b0, avg(cast(y = 1 as int)) as b1, avg(cast(y = 2 as int)) as b2 from used),
g as (select pool, count(*) as n, count(m0) as market_n, count(*) filter ({_PICK} = y) as hits, avg({_LOSS}) as loss, avg({_BRIER}) as brier, avg({_RPS}) as rps, avg({_OF.format("b0", "b1", "b2")}) as base_loss,
    avg({_OF.format("m0", "m1", "m2")}) filter (m0 is not null) as market_loss, avg({_LOSS}) filter (m0 is not null) as loss_with_market from chosen left join market using (contest_id), base group by 1)
select *, n >= 1000 as reliable, (hits / cast(n as double) + 1.9208 / n - {_W}) / (1 + 3.8416 / n) as low, (hits / cast(n as double) + 1.9208 / n + {_W}) / (1 + 3.8416 / n) as high from g""")
def forecast_record(spark, sf):
    """AGG15: the last forecast of each contest before its start, by pool: losses against the base rate known before the first forecast and against the market where there is one, hits with Wilson intervals."""
    c = contests(spark, sf)
    published = models(forecasts(c)).withColumn("made_at", F.col("event_ts") + F.make_interval(mins=F.expr(f"cast({_MADE} as int)")))
    chosen = last_before(published, "contest_id", "made_at", "event_ts", "model_id")
    base = base_rates(c.withColumn("y", outcome()), "y", "available_at", published.agg(F.min("made_at").alias("first_at")))
    fair = _triples(spark, sf).withColumn("s", 1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c"))
    market = fair.groupBy(F.col("contest").alias("contest_id")).agg(F.array(*[F.avg(1 / F.col(x) / F.col("s")) for x in "abc"]).alias("m"))
    rows = chosen.withColumn("p", F.array("p0", "p1", "p2")).join(market, "contest_id", "left").join(F.broadcast(base))  # one row
    loss, y = lambda p: scores.log_loss(F.col(p), F.col("y")), F.col("y")
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    there = F.col("m").isNotNull()
    g = rows.groupBy("pool").agg(
        F.count("*").alias("n"), F.count("m").alias("market_n"), F.sum((pick == y).cast("long")).alias("hits"), F.avg(loss("p")).alias("loss"), F.avg(scores.brier(F.col("p"), y)).alias("brier"), F.avg(scores.ranked(F.col("p"), y)).alias("rps"),
        F.avg(loss("base")).alias("base_loss"), F.avg(F.when(there, loss("m"))).alias("market_loss"), F.avg(F.when(there, loss("p"))).alias("loss_with_market"),
    )
    n, r = F.col("n"), F.col("hits") / F.col("n")
    half = 1.96 * F.sqrt(r * (1 - r) / n + 0.9604 / n / n)
    return g.select("*", (n >= 1000).alias("reliable"), ((r + 1.9208 / n - half) / (1 + 3.8416 / n)).alias("low"), ((r + 1.9208 / n + half) / (1 + 3.8416 / n)).alias("high"))


_NOW = "timestamp '2024-01-20'"
_SEEN = f"""held as (select contest_id, case when contest_id % 13 = 0 then null else left_n end as left_n, case when contest_id % 13 = 0 then null else right_n end as right_n, case when contest_id % 13 = 0 then 'cancelled' else 'final' end as status,
    available_at as first_seen from contests where available_at < {_NOW} and contest_id % 3 = 0),
seen as (select contest_id, case when contest_id % 7 = 0 then left_n + 1 else left_n end as left_n, right_n, case when contest_id % 11 = 0 then 'cancelled' else 'final' end as status, available_at + interval 1 hour as seen_at from contests where available_at < {_NOW} and contest_id % 5 <> 1),
clean as (select contest_id, case when status <> 'cancelled' then left_n end as left_n, case when status <> 'cancelled' then right_n end as right_n, status, seen_at from seen)"""


@query(f"""with {CONTESTS}, {_SEEN}
select contest_id, case when s.status is not null then s.left_n else h.left_n end as left_n, case when s.status is not null then s.right_n else h.right_n end as right_n, coalesce(s.status, h.status) as status, least(h.first_seen, s.seen_at) as first_seen,
case when h.status is null then 'new' when s.status is null then 'kept' when h.left_n is not distinct from s.left_n and h.right_n is not distinct from s.right_n and h.status = s.status then 'same' else 'changed' end as action, coalesce(s.status, h.status) = 'cancelled' as is_void
from held h full join clean s using (contest_id)""")
def result_upsert(spark, sf):
    """JN17: results seen anew over those held; changed values apply, the first time seen stays, cancelled contests have no result."""
    return _upserted(contests(spark, sf))


def _upserted(c):
    c = c.where(f"available_at < {_NOW}")
    off = F.col("contest_id") % 13 == 0
    held = c.where("contest_id % 3 = 0").select("contest_id", *[F.when(~off, F.col(x)).alias(x) for x in ("left_n", "right_n")], F.when(off, "cancelled").otherwise("final").alias("status"), F.col("available_at").alias("first_seen"))
    left = F.when(F.col("contest_id") % 7 == 0, F.col("left_n") + 1).otherwise(F.col("left_n"))
    seen = c.where("contest_id % 5 <> 1").select("contest_id", left.alias("left_n"), "right_n", F.when(F.col("contest_id") % 11 == 0, "cancelled").otherwise("final").alias("status"), (F.col("available_at") + F.expr("interval 1 hour")).alias("seen_at"))
    return upsert_results(held, seen, "contest_id", ["left_n", "right_n"], ["cancelled"])


@query(f"""with {CONTESTS}, {_SEEN} select contest_id, event_ts, (epoch({_NOW}) - floor(epoch(event_ts))) / 3600.0 - 6 as hours_late from contests where event_ts + interval 6 hour < {_NOW} and contest_id not in (select contest_id from held union all select contest_id from seen)""")
def pending_results(spark, sf):
    """JN17: contests without any result six hours after their start."""
    c = contests(spark, sf)
    return pending(c.select("contest_id", "event_ts"), _upserted(c), "contest_id", "event_ts", F.expr(_NOW), 6)
