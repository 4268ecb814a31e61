"""As-of joins and features at a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, as_of_window, last_state, nearest
from tidemark.operators.features import running
from tidemark.operators.prices import triples_at
from tidemark.plans.registry import Registry
from tidemark.sources.tables import CONTESTS, ENTITY, FORECASTS, QUOTES, contests, entity_rows, forecasts, outcome, quotes, read_table, seconds

query = Registry()


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return entity_rows(contests(spark, sf))


def _state(rows: DataFrame, values: dict, extra: list[str] | None = None) -> DataFrame:
    """Running values of each entity, one row for each time they became known."""
    return last_state(running(rows, ["entity_id", *(extra or [])], ["available_at", "contest_id"], values), ["entity_id", *(extra or [])], "available_at", ["contest_id"])


ASK = ["contest_id", "side", "entity_id", "cutoff"]
LAST = "qualify row_number() over (partition by {k}, available_at order by contest_id desc) = 1"


def _state_sql(values: str, keys: str = "entity_id") -> str:
    return f"state as (select {keys}, available_at, contest_id, {values} from entity_rows {LAST.format(k=keys)})"


OVER = "over (partition by entity_id order by available_at, contest_id rows between {n} preceding and current row)"
ALL = "over (partition by entity_id order by available_at, contest_id rows unbounded preceding)"


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql("pts as last_pts, contest_id as last_contest")}
select a.contest_id, a.side, a.entity_id, s.last_contest, s.last_pts from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at""")
def asof_last_result(spark, sf):
    """JN2: the latest result of each entity known at the cutoff."""
    rows = _rows(spark, sf)
    state = last_state(rows, ["entity_id"], "available_at", ["contest_id"]).select("entity_id", "available_at", F.col("contest_id").alias("last_contest"), F.col("pts").alias("last_pts"))
    return as_of(rows.select(*ASK), state, ["entity_id"], "cutoff", "available_at", ["last_contest", "last_pts"]).select("contest_id", "side", "entity_id", "last_contest", "last_pts")


_W1 = ", ".join(f"case when count(*) {OVER.format(n=n - 1)} = {n} then sum(pts) {OVER.format(n=n - 1)} end as form{n}" for n in (3, 5, 10))


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql(_W1)}
select a.contest_id, a.side, s.form3, s.form5, s.form10, s.form5 / 5.0 as mean5 from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at""")
def form_last_n(spark, sf):
    """WIN1: sums of the last 3, 5 and 10 results known at the cutoff, null with fewer."""
    rows = _rows(spark, sf)
    state = _state(rows, {f"form{n}": (F.sum, "pts", n, n) for n in (3, 5, 10)})
    out = as_of(rows.select(*ASK), state, ["entity_id"], "cutoff", "available_at", ["form3", "form5", "form10"])
    return out.select("contest_id", "side", *[F.col(f"form{n}").cast("long") for n in (3, 5, 10)], (F.col("form5") / 5.0).alias("mean5"))


_W2 = "over (partition by entity_id, side order by available_at, contest_id rows between 9 preceding and current row)"


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql(f"case when count(*) {_W2} >= 5 then avg(cast(pts = 3 as int)) {_W2} end as rate", "entity_id, side")}
select a.contest_id, a.side, s.rate as side_rate from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.side = s.side and a.cutoff >= s.available_at""")
def side_rate(spark, sf):
    """WIN2: share won of the last ten on the same side, with at least five."""
    rows = _rows(spark, sf).withColumn("won", (F.col("pts") == 3).cast("int"))
    state = _state(rows, {"side_rate": (F.avg, "won", 10, 5)}, ["side"])
    return as_of(rows.select(*ASK), state, ["entity_id", "side"], "cutoff", "available_at", ["side_rate"]).select("contest_id", "side", "side_rate")


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql(f"max(event_ts) {ALL} as last_ts")},
r as (select a.contest_id, a.side, (floor(epoch(a.event_ts)) - floor(epoch(s.last_ts))) / 86400.0 as d from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at)
select contest_id, side, d as rest_days, least(d, 14.0) as rest_capped, d > 7 as after_break, ln(1 + d) - ln(4.0) as log_rest from r""")
def rest_days(spark, sf):
    """WIN3 and WIN10: rest since the previous known event, capped, with break flag, and its logarithm against three days."""
    rows = _rows(spark, sf)
    state = _state(rows, {"last_ts": (F.max, "event_ts", None, 1)})
    out = as_of(rows.select(*ASK, "event_ts"), state, ["entity_id"], "cutoff", "available_at", ["last_ts"])
    d = (seconds("event_ts") - seconds("last_ts")) / F.lit(86400.0)
    return out.select("contest_id", "side", d.alias("rest_days"), F.when(d.isNull(), F.lit(14.0)).otherwise(F.least(d, F.lit(14.0))).alias("rest_capped"), (d > 7).alias("after_break"), (F.log1p(d) - F.log(F.lit(4.0))).alias("log_rest"))


@query(f"""with {CONTESTS}, {ENTITY},
g as (select *, sum(cast(pts <> 3 as int)) {ALL} as island from entity_rows),
r as (select *, sum(cast(pts = 3 as int)) over (partition by entity_id, island order by available_at, contest_id rows unbounded preceding) as run from g),
state as (select entity_id, available_at, run from r {LAST.format(k="entity_id")})
select a.contest_id, a.side, cast(coalesce(s.run, 0) as bigint) as win_run from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at""")
def win_run(spark, sf):
    """WIN4: length of the current run of wins (gaps and islands)."""
    rows = _rows(spark, sf)
    order = Window.partitionBy("entity_id").orderBy("available_at", "contest_id")
    islands = rows.withColumn("island", F.sum((F.col("pts") != 3).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum((F.col("pts") == 3).cast("int")).over(Window.partitionBy("entity_id", "island").orderBy("available_at", "contest_id").rowsBetween(Window.unboundedPreceding, 0))
    state = last_state(islands.withColumn("run", run), ["entity_id"], "available_at", ["contest_id"])
    return as_of(rows.select(*ASK), state, ["entity_id"], "cutoff", "available_at", ["run"]).select("contest_id", "side", F.coalesce("run", F.lit(0)).cast("long").alias("win_run"))


@query(f"""with {CONTESTS}, {ENTITY},
s1 as (select entity_id, available_at, contest_id, list(opp_id) {OVER.format(n=4)} as opps, avg(pts) {ALL} as ppg from entity_rows),
state as (select * from s1 {LAST.format(k="entity_id")}),
asked as (select a.contest_id, a.side, a.cutoff, s.opps from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at),
o as (select contest_id, side, cutoff, unnest(opps) as opp from asked),
rated as (select o.contest_id, o.side, s.ppg from o asof left join state s on o.opp = s.entity_id and o.cutoff >= s.available_at)
select a.contest_id, a.side, case when count(r.ppg) >= 3 then avg(r.ppg) end as opp_strength from asked a left join rated r using (contest_id, side) group by 1, 2""")
def opponent_strength(spark, sf):
    """WIN5: mean points a contest of the last five opponents, each rated at the same cutoff, with at least three rated."""
    rows = _rows(spark, sf)
    state = _state(rows, {"opps": (F.collect_list, "opp_id", 5, 1), "ppg": (F.avg, "pts", None, 1)})
    asked = as_of(rows.select(*ASK), state, ["entity_id"], "cutoff", "available_at", ["opps"])
    each = asked.select("contest_id", "side", "cutoff", F.explode_outer("opps").alias("opp"))
    rated = as_of(each, state.select(F.col("entity_id").alias("opp"), "available_at", "ppg"), ["opp"], "cutoff", "available_at", ["ppg"])
    return rated.groupBy("contest_id", "side").agg(F.when(F.count("ppg") >= 3, F.avg("ppg")).alias("opp_strength"))


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql(f"count(*) {ALL} as n")}, first_season as (select min(season) as s0 from contests)
select a.contest_id, a.side, coalesce(s.n, 0) as history, coalesce(s.n, 0) >= 5 as available,
    case when coalesce(s.n, 0) >= 5 then null when a.season = (select s0 from first_season) then 'dataset_start' when s.n is null then 'new_entity' else 'insufficient_history' end as reason
from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at""")
def missing_reason(spark, sf):
    """WIN6: why a form value is missing, never a zero in its place."""
    rows = _rows(spark, sf)
    first = rows.agg(F.min("season").alias("s0"))
    state = _state(rows, {"n": (F.count, "contest_id", None, 1)})
    out = as_of(rows.select(*ASK, "season"), state, ["entity_id"], "cutoff", "available_at", ["n"]).join(F.broadcast(first))
    enough = F.coalesce("n", F.lit(0)) >= 5
    reason = F.when(enough, None).when(F.col("season") == F.col("s0"), "dataset_start").when(F.col("n").isNull(), "new_entity").otherwise("insufficient_history")
    return out.select("contest_id", "side", F.coalesce("n", F.lit(0)).cast("long").alias("history"), enough.alias("available"), reason.alias("reason"))


@query(f"""with {CONTESTS}, {ENTITY}, {_state_sql(f"list(own_n) {OVER.format(n=9)} as v, avg(own_n) {OVER.format(n=2)} as m3, avg(own_n) {OVER.format(n=4)} as m5")},
r as (select a.contest_id, a.side, s.v, s.m3, s.m5 from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at)
select contest_id, side, m3, m5, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * pow(0.5, (len(v) - i) / 3.0))) / list_sum(list_transform(range(1, len(v) + 1), lambda i: pow(0.5, (len(v) - i) / 3.0))) as ewma from r""")
def rolling_means(spark, sf):
    """WIN7: rolling means and an exponentially weighted mean of the last ten, half-life three rows."""
    rows = _rows(spark, sf)
    state = _state(rows, {"v": (F.collect_list, "own_n", 10, 1), "m3": (F.avg, "own_n", 3, 1), "m5": (F.avg, "own_n", 5, 1)})
    out = as_of(rows.select(*ASK), state, ["entity_id"], "cutoff", "available_at", ["v", "m3", "m5"])
    weight = F.transform("v", lambda x, i: F.pow(F.lit(0.5), (F.size("v") - 1 - i) / F.lit(3.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return out.select("contest_id", "side", "m3", "m5", (total(F.zip_with("v", weight, lambda x, w: x * w)) / total(weight)).alias("ewma"))


@query(f"""with {CONTESTS}, {ENTITY}
select a.contest_id, a.side, count(f.contest_id) as n7, avg(f.own_n) as mean7, max(f.own_n) as max7
from entity_rows a left join entity_rows f on a.entity_id = f.entity_id and floor(epoch(f.available_at)) between floor(epoch(a.cutoff)) - 7 * 86400 and floor(epoch(a.cutoff)) group by 1, 2""")
def calendar_window(spark, sf):
    """WIN8: counts and means over the seven days up to the cutoff."""
    rows = _rows(spark, sf)
    return as_of_window(rows.select(*ASK), rows.select("entity_id", "available_at", "contest_id", "own_n"), ["entity_id"], "cutoff", "available_at", 7 * 86400, {"n7": (F.count, "contest_id"), "mean7": (F.avg, "own_n"), "max7": (F.max, "own_n")}).select("contest_id", "side", "n7", "mean7", "max7")


@query(f"""with {CONTESTS}, {ENTITY},
e as (select a.contest_id, a.side, count(f.contest_id) as congestion from entity_rows a left join entity_rows f on a.entity_id = f.entity_id and floor(epoch(f.available_at)) between floor(epoch(a.cutoff)) - 3 * 86400 and floor(epoch(a.cutoff)) group by 1, 2),
p as (select pool, available_at, contest_id, avg(left_n) over (partition by pool order by available_at, contest_id rows between 99 preceding and current row) as pool_mean from contests),
ps as (select * from p qualify row_number() over (partition by pool, available_at order by contest_id desc) = 1),
q as (select c.contest_id, ps.pool_mean, (floor(epoch(c.event_ts)) - floor(epoch(c.season))) / 86400.0 as days_in from contests c asof left join ps on c.pool = ps.pool and c.event_ts - interval 90 minute >= ps.available_at)
select contest_id, side, congestion, pool_mean, days_in from e join q using (contest_id)""")
def pool_priors(spark, sf):
    """WIN9: mean of the pool's last 100 known contests, recent congestion of the entity, days into the season."""
    c = contests(spark, sf).withColumn("cutoff", F.col("event_ts") - F.expr("interval 90 minutes"))
    rows = entity_rows(c)
    busy = as_of_window(rows.select(*ASK), rows.select("entity_id", "available_at", "contest_id"), ["entity_id"], "cutoff", "available_at", 3 * 86400, {"congestion": (F.count, "contest_id")})
    state = last_state(running(c, ["pool"], ["available_at", "contest_id"], {"pool_mean": (F.avg, "left_n", 100, 1)}), ["pool"], "available_at", ["contest_id"])
    prior = as_of(c.select("contest_id", "pool", "cutoff", "event_ts", "season"), state, ["pool"], "cutoff", "available_at", ["pool_mean"])
    days = (seconds("event_ts") - seconds("season")) / F.lit(86400.0)
    return busy.select("contest_id", "side", "congestion").join(prior.select("contest_id", "pool_mean", days.alias("days_in")), "contest_id")


_STAGES = [("t-24h", 1440), ("t-90m", 90), ("t-30m", 30), ("kickoff", 5)]
_STAGES_SQL = "stages(stage, minutes) as (values " + ", ".join(f"('{s}', {m})" for s, m in _STAGES) + ")"


@query(f"""with {CONTESTS}, {ENTITY}, {_STAGES_SQL}, {_state_sql("pts as last_pts")},
a as (select contest_id, side, entity_id, stage, event_ts - to_minutes(minutes) as at from entity_rows, stages)
select a.contest_id, a.side, a.stage, s.last_pts, case when s.last_pts is null then 'UNKNOWN' else 'KNOWN' end as status from a asof left join state s on a.entity_id = s.entity_id and a.at >= s.available_at""")
def asof_stages(spark, sf):
    """JN3: the same question at every stage before the event; what is unknown stays as a row."""
    rows = _rows(spark, sf)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("minutes")) for s, m in _STAGES])
    asks = rows.select("contest_id", "side", "entity_id", "event_ts", F.explode(stages).alias("s")).select("contest_id", "side", "entity_id", "s.stage", (F.col("event_ts") - F.make_dt_interval(mins=F.col("s.minutes"))).alias("at"))
    state = last_state(rows, ["entity_id"], "available_at", ["contest_id"]).select("entity_id", "available_at", F.col("pts").alias("last_pts"))
    out = as_of(asks, state, ["entity_id"], "at", "available_at", ["last_pts"])
    return out.select("contest_id", "side", "stage", "last_pts", F.when(F.col("last_pts").isNull(), "UNKNOWN").otherwise("KNOWN").alias("status"))


_ASK_Q = "asks as (select o_orderkey as contest, timestamp '2000-01-01' as at_ts from orders)"


@query(f"""with {QUOTES}, {_ASK_Q},
l as (select q.contest, maker, outcome, arg_max(price, (observed_at, seq)) as price, max(observed_at) as seen, any_value(at_ts) as at_ts from quotes q join asks a on q.contest = a.contest where observed_at <= at_ts and observed_at >= at_ts - interval 2500 day group by 1, 2, 3)
select contest, maker, max(case when outcome = 0 then price end) as p0, max(case when outcome = 1 then price end) as p1, max(case when outcome = 2 then price end) as p2, floor(epoch(max(seen))) - floor(epoch(min(seen))) as spread_s
from l group by 1, 2 having count(*) = 3 and floor(epoch(max(seen))) - floor(epoch(min(seen))) <= 1000 * 86400""")
def asof_triples(spark, sf):
    """JN4: the last complete triple of each maker at the decision time, within bounds of age and spread."""
    asks = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest"), F.expr("timestamp '2000-01-01'").alias("at"))
    return triples_at(quotes(spark, sf), asks, max_age=2500 * 86400, max_spread=1000 * 86400).select("contest", "maker", "p0", "p1", "p2", F.col("spread").alias("spread_s"))


@query(f"""with {QUOTES}, asks as (select o_orderkey as contest, cast(o_orderdate as timestamp) as cut, cast(o_orderdate as timestamp) + interval 90 day as start_ts from orders),
q as (select a.contest, maker, outcome, arg_max(price, (observed_at, seq)) as price from asks a join quotes q on q.contest = a.contest and observed_at > cut and observed_at < start_ts group by 1, 2, 3),
m as (select contest, maker from q group by 1, 2 having count(*) = 3), s as (select contest, count(*) as makers from m group by 1), n as (select contest, count(*) as quotes_n from q group by 1)
select contest, case when s.makers is not null then 'ELIGIBLE' else 'NOT_ELIGIBLE' end as status, case when s.makers is not null then null when n.quotes_n is null then 'no_quote' else 'incomplete' end as reason, coalesce(makers, 0) as makers
from asks a left join s using (contest) left join n using (contest)""")
def forward_eligible(spark, sf):
    """JN5: whether a complete set of prices was seen after the decision and before the event, with the reason if not."""
    asks = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest"), F.col("o_orderdate").cast("timestamp").alias("cut"))
    q = quotes(spark, sf).join(asks, "contest").where("observed_at > cut and observed_at < cut + interval 90 days").groupBy("contest", "maker").agg(F.countDistinct("outcome").alias("n"))
    per = q.groupBy("contest").agg(F.sum((F.col("n") == 3).cast("long")).alias("makers"))
    out = asks.select("contest").join(per, "contest", "left")
    ok = F.coalesce("makers", F.lit(0)) > 0
    return out.select("contest", F.when(ok, "ELIGIBLE").otherwise("NOT_ELIGIBLE").alias("status"), F.when(ok, None).when(F.col("makers").isNull(), "no_quote").otherwise("incomplete").alias("reason"), F.coalesce("makers", F.lit(0)).alias("makers"))


@query("""with a as (select o_orderkey, o_custkey as k, cast(o_orderdate as date) as d from orders), f as (select o_orderkey as fact_id, (o_custkey + 1) as k, cast(o_orderdate as date) as fd from orders)
select o_orderkey, fact_id, cast(fd - d as bigint) as day_gap from a join f using (k) where abs(fd - d) <= 30 qualify row_number() over (partition by o_orderkey order by abs(fd - d), fd - d, fact_id) = 1""")
def nearest_within_days(spark, sf):
    """JN6 and JN7: the exact day first, else the nearest within a tolerance."""
    o = read_table(spark, sf, "orders")
    a = o.select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("d"))
    f = o.select(F.col("o_orderkey").alias("fact_id"), (F.col("o_custkey") + 1).alias("k"), F.col("o_orderdate").cast("date").alias("fd"))
    return nearest(a, f, ["k"], "d", "fd", 30, "fact_id").select("o_orderkey", "fact_id", F.col("day_gap").cast("long"))


@query(f"""with {CONTESTS}, {FORECASTS} select f.contest_id, f.p0, f.p1, f.p2, c.left_n, c.right_n from forecasts f join contests c using (contest_id) where f.season >= timestamp '2024-01-08'""")
def forecast_results(spark, sf):
    """JN1: forecasts with results of chosen seasons."""
    c = contests(spark, sf)
    return forecasts(c).where("season >= timestamp '2024-01-08'").join(c.select("contest_id", "left_n", "right_n"), "contest_id").select("contest_id", "p0", "p1", "p2", "left_n", "right_n")


@query(f"""with {CONTESTS}, {ENTITY}, x as (select entity_id, contest_id, cutoff, lag(available_at) over (partition by entity_id order by event_ts, contest_id) as prev from entity_rows)
select entity_id, contest_id from x where prev > cutoff""")
def replay_violations(spark, sf):
    """WIN16: contests whose entity had an earlier one that was not yet known at the cutoff, which a replay in event order would leak."""
    prev = F.lag("available_at").over(Window.partitionBy("entity_id").orderBy("event_ts", "contest_id"))
    return _rows(spark, sf).withColumn("prev", prev).where("prev > cutoff").select("entity_id", "contest_id")


@query(f"""with {CONTESTS}, {ENTITY}, late as (select a.contest_id, a.side, count(*) filter (f.available_at > a.cutoff and f.event_ts < a.event_ts) as late_rows, count(*) filter (f.available_at <= a.cutoff) as visible_rows, bool_or(f.contest_id = a.contest_id and f.available_at <= a.cutoff) as own_seen
from entity_rows a join entity_rows f on a.entity_id = f.entity_id group by 1, 2) select * from late""")
def temporal_audit(spark, sf):
    """LKG5: for each contest, facts that are late, visible, or its own result seen too early; by running counts, without pairs."""
    rows = _rows(spark, sf)
    ask = rows.select("entity_id", F.col("cutoff").alias("t"), F.lit(1).alias("o"), "contest_id", "side", "event_ts", F.lit(0).alias("known"), (F.col("available_at") <= F.col("cutoff")).alias("own_seen"))
    fact = rows.select("entity_id", F.col("available_at").alias("t"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("contest_id"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("timestamp").alias("event_ts"), F.lit(1).alias("known"), F.lit(None).cast("boolean").alias("own_seen"))
    w = Window.partitionBy("entity_id").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    visible = ask.unionByName(fact).withColumn("visible_rows", F.sum("known").over(w)).where("o = 1")
    earlier = rows.select("contest_id", "side", (F.count("*").over(Window.partitionBy("entity_id").orderBy(F.unix_micros("event_ts")).rangeBetween(Window.unboundedPreceding, -1))).alias("earlier"))
    out = visible.join(earlier, ["contest_id", "side"])
    return out.select("contest_id", "side", (F.col("earlier") - F.col("visible_rows")).alias("late_rows"), "visible_rows", "own_seen")
