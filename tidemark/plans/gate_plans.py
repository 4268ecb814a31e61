"""Stages on their common contests, gates with two looks, answers above cut-offs from history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators.gates import answered, block_interval, history_cuts, paired_stages, two_looks
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _BRIER, _LOSS, _M
from tidemark.sources.tables import contests, forecasts, models

query = Registry()
_PICK = "case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end"
_HALF = "1.96 * sqrt(sum(e * e) * count(*) / (count(*) - 1.0)) / first(a)"
LEVELS = [1.0, 0.8, 0.6, 0.4]
INTERIM, FINAL = 100, 300


def _scored(spark, sf):
    m = models(forecasts(contests(spark, sf))).withColumn("p", F.array("p0", "p1", "p2"))
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    return m.withColumns({"loss": scores.log_loss(F.col("p"), F.col("y")), "brier": scores.brier(F.col("p"), F.col("y")), "hit": (pick == F.col("y")).cast("double"), "week": F.date_trunc("week", "event_ts")})


@query(f"""{_M}, s as (select contest_id, model_id, date_trunc('week', event_ts) as week, {_LOSS} as loss, {_BRIER} as brier, cast({_PICK} = y as int) as hit from models),
w as (select *, count(*) over (partition by contest_id) = 3 as paired, max(loss) filter (model_id = 3) over (partition by contest_id) as last from s),
m as (select model_id, count(*) as due, count(*) filter (paired) as paired, avg(loss) filter (paired) as loss, avg(brier) filter (paired) as brier, avg(hit) filter (paired) as hit from w group by 1),
b as (select model_id, week, sum(loss - last) as s, count(*) as n from w where paired group by 1, 2),
e as (select *, s - n * sum(s) over k / sum(n) over k as e, sum(n) over k as a, sum(s) over k as t from b window k as (partition by model_id)),
i as (select model_id, count(*) as blocks, first(t) / first(a) as delta, case when count(*) > 1 then {_HALF} end as half from e group by 1)
select model_id, due, paired, loss, brier, hit, case when model_id < 3 then delta end as delta, case when model_id < 3 then delta - half end as low, case when model_id < 3 then delta + half end as high, blocks,
case when model_id = 3 then null when blocks < 3 then 'too_few_blocks' when delta + half < 0 then 'better' when delta - half > 0 then 'worse' else 'no_difference' end as verdict from m left join i using (model_id)""")
def stage_comparison(spark, sf):
    """MET14: three forecasts of a contest on the contests that have all of them, each against the last, with intervals over weeks."""
    return paired_stages(_scored(spark, sf), "contest_id", "model_id", [1, 2, 3], "week", ["loss", "brier", "hit"])


@query(f"""{_M}, s as (select contest_id, pool, date_trunc('week', event_ts) as week, unnest([{{'t': 'log_loss', 'v': {_LOSS}}}, {{'t': 'brier', 'v': {_BRIER}}}]) as x, model_id from models where model_id < 3),
d as (select contest_id, pool, week, x.t as target, max(x.v) filter (model_id = 1) - max(x.v) filter (model_id = 2) as d from s group by 1, 2, 3, 4),
b as (select pool, target, week, sum(d) as s, count(d) as n from d group by 1, 2, 3),
e as (select *, s - n * sum(s) over k / sum(n) over k as e, sum(n) over k as a, sum(s) over k as t from b window k as (partition by pool, target)),
i as (select pool, target, first(a) as n, first(t) / first(a) as delta, case when count(*) > 1 then {_HALF} end as half from e group by 1, 2)
select pool, cast(min(n) as bigint) as n, count(*) as targets, case when min(n) >= {INTERIM} and bool_or(coalesce(delta - half > 0, false)) then 'withdrawn' when min(n) >= {FINAL} and count(*) = 2 and bool_and(coalesce(delta + half < 0, false)) then 'verified' else 'open' end as status from i group by 1""")
def two_look_gate(spark, sf):
    """MET12 and AGG26: candidate against champion on two targets by pool, withdrawn at the interim look, verified at the final one."""
    one = lambda m, c: F.max(F.when(F.col("model_id") == m, F.col(c)))
    d = _scored(spark, sf).where("model_id < 3").groupBy("contest_id", "pool", "week").agg(*[(one(1, c) - one(2, c)).alias(c) for c in ("loss", "brier")])
    both = d.select("pool", "week", F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(c).alias("d")) for t, c in (("log_loss", "loss"), ("brier", "brier"))])).alias("x")).select("pool", "week", "x.*")
    sums = both.groupBy("pool", "target", "week").agg(F.sum("d").alias("s"), F.count("d").alias("n"))
    return two_looks(block_interval(sums, ["pool", "target"]), ["pool"], 2, INTERIM, FINAL)


_CUT = "unnest([" + ", ".join(f"{{'level': cast({x} as double), 'cut': " + ("cast(0 as double)" if x >= 1 else f"quantile_cont(c, {round(1 - x, 12)})") + "}" for x in LEVELS) + "]) as x"
_R, _N = "(hits / answered)", "cast(answered as double)"
_WILSON = f"1.96 * sqrt({_R} * (1 - {_R}) / {_N} + 0.9604 / {_N} / {_N})"


@query(f"""{_M}, s as (select model_id, event_ts < timestamp '2024-01-15' as early, greatest(p0, p1, p2) as c, {_LOSS} as loss, {_PICK} = y as hit from models),
h as (select model_id, {_CUT} from s where early group by 1), q as (select model_id, x.level as level, x.cut as cut from h), l as (select *, count(*) over (partition by model_id) as n from s where not early),
g as (select model_id, level, cut, count(*) filter (c >= cut - 1e-12) as answered, count(*) filter (c >= cut - 1e-12 and hit) as hits, avg(loss) filter (c >= cut - 1e-12) as loss, max(n) as n from l join q using (model_id) group by 1, 2, 3)
select model_id, level, cut, answered, answered / n as coverage, hits, case when answered > 0 then {_R} end as accuracy, case when answered > 0 then ({_R} + 1.9208 / {_N} - {_WILSON}) / (1 + 3.8416 / {_N}) end as low,
case when answered > 0 then ({_R} + 1.9208 / {_N} + {_WILSON}) / (1 + 3.8416 / {_N}) end as high, loss from g""")
def selective_levels(spark, sf):
    """AGG17: cut-offs from the earlier window's certainty, and what the later window answers above them."""
    s = _scored(spark, sf).withColumns({"sure": F.greatest("p0", "p1", "p2"), "early": F.col("event_ts") < F.expr("timestamp '2024-01-15'")})
    cuts = history_cuts(s.where("early"), "model_id", "sure", LEVELS)
    return answered(s.where("not early"), cuts, "model_id", "sure", F.col("hit") == 1, F.col("loss"), LEVELS)
