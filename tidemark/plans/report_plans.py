"""Rollups, monitoring tables, drift, splits and leakage audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import drift, tables
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _LOSS, _M, _scored
from tidemark.sources.tables import CONTESTS, ENTITY, FORECASTS, contests, entity_rows, forecasts, models, read_table

query = Registry()
DAY0 = "timestamp '2024-01-15'"


@query(f"""with {CONTESTS}, n as (select pool, season, count(*) as n, count(distinct left_id) as members from contests group by 1, 2) select pool, strftime(season, '%Y-%m-%d') as season, n, members,
case when n >= 450 then 'complete' when n >= 300 then 'partial' else 'incomplete' end as class from n""")
def season_classes(spark, sf):
    """AGG1: completeness of each pool and season against the expected count."""
    n = contests(spark, sf).groupBy("pool", "season").agg(F.count("*").alias("n"), F.countDistinct("left_id").alias("members"))
    return n.select("pool", F.date_format("season", "yyyy-MM-dd").alias("season"), "n", "members", F.when(F.col("n") >= 450, "complete").when(F.col("n") >= 300, "partial").otherwise("incomplete").alias("class"))


@query(f"""with {CONTESTS}, c as (select pool, count(*) as n, count(*) filter (left_n is null) as nulls, count(*) filter (left_n > 3) as odd, max(event_ts) as last_ts from contests group by 1),
k as (select pool, unnest(['rows', 'nulls', 'range', 'fresh']) as rule, unnest([cast(n as double), cast(nulls as double) / n, cast(odd as double) / n, floor(epoch(timestamp '2024-02-01') - epoch(last_ts)) / 86400]) as value, unnest([n >= 100, nulls = 0, odd * 4 < n, last_ts > timestamp '2024-01-29']) as ok from c)
select pool, rule, value, ok, case when ok then 'pass' when rule in ('rows', 'nulls') then 'block' else 'warn' end as severity from k""")
def quality_checks(spark, sf):
    """AGG2, AGG3, AGG20: a suite of checks as one table with severities."""
    c = contests(spark, sf).groupBy("pool").agg(F.count("*").alias("n"), F.sum(F.col("left_n").isNull().cast("long")).alias("nulls"), F.sum((F.col("left_n") > 3).cast("long")).alias("odd"), F.max("event_ts").alias("last_ts"))
    age = F.floor((F.unix_micros(F.expr("timestamp '2024-02-01'")) - F.unix_micros("last_ts")) / 1e6) / 86400
    row = lambda rule, value, ok: F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("value"), ok.alias("ok"))
    rules = F.array(row("rows", F.col("n"), F.col("n") >= 100), row("nulls", F.col("nulls") / F.col("n"), F.col("nulls") == 0), row("range", F.col("odd") / F.col("n"), F.col("odd") * 4 < F.col("n")), row("fresh", age, F.col("last_ts") > F.expr("timestamp '2024-01-29'")))
    out = c.select("pool", F.explode(rules).alias("r")).select("pool", "r.*")
    return out.withColumn("severity", F.when(F.col("ok"), "pass").when(F.col("rule").isin("rows", "nulls"), "block").otherwise("warn"))


@query(f"""with {CONTESTS}, m as (select pool, season, count(*) as due, count(*) filter (left_n + right_n > 0) as done, count(*) filter (contest_id % 3 <> 0) as timed from contests group by 1, 2)
select pool, strftime(season, '%Y-%m-%d') as season, due, done, cast(timed as double) / due as timed_share, cast(done as double) / due >= 0.8 and due > 100 as trainable, case when due >= 500 then 'high' when due >= 200 then 'mid' else 'low' end as tier from m""")
def coverage_matrix(spark, sf):
    """AGG4: coverage of each pool and season with decision and volume tier."""
    m = contests(spark, sf).groupBy("pool", "season").agg(F.count("*").alias("due"), F.sum((F.col("left_n") + F.col("right_n") > 0).cast("long")).alias("done"), F.sum((F.col("contest_id") % 3 != 0).cast("long")).alias("timed"))
    share = lambda c: F.col(c).cast("double") / F.col("due")
    return m.select("pool", F.date_format("season", "yyyy-MM-dd").alias("season"), "due", "done", share("timed").alias("timed_share"), ((share("done") >= 0.8) & (F.col("due") > 100)).alias("trainable"), F.when(F.col("due") >= 500, "high").when(F.col("due") >= 200, "mid").otherwise("low").alias("tier"))


_CALLS = "calls as (select event_id, event_type as source, user_id % 4 as endpoint, ts, event_id % 9 <> 0 as ok, cast(floor(value) as bigint) as latency from events)"


def _calls(spark, sf) -> DataFrame:
    return read_table(spark, sf, "events").select("event_id", F.col("event_type").alias("source"), (F.col("user_id") % 4).alias("endpoint"), "ts", (F.col("event_id") % 9 != 0).alias("ok"), F.floor("value").cast("long").alias("latency"))


@query(f"""with {_CALLS} select source, endpoint, strftime(max(ts) filter (ok), '%Y-%m-%d %H:%M:%S') as last_ok, arg_max(event_id, (ts, event_id)) filter (not ok) as last_error, max(ts) filter (ok) < timestamp '2024-01-30' as stale from calls group by 1, 2""")
def freshness(spark, sf):
    """AGG5: last success and last error by source and endpoint."""
    ok = F.max(F.when(F.col("ok"), F.col("ts")))
    return _calls(spark, sf).groupBy("source", "endpoint").agg(F.date_format(ok, "yyyy-MM-dd HH:mm:ss").alias("last_ok"), F.max_by("event_id", F.when(~F.col("ok"), F.struct("ts", "event_id"))).alias("last_error"), (ok < F.expr("timestamp '2024-01-30'")).alias("stale"))


@query(f"""with {_CALLS} select source, endpoint, ok, count(*) as n from calls group by grouping sets ((source, ok), (endpoint, ok), (source, endpoint, ok))""")
def call_coverage(spark, sf):
    """AGG6: success and failure by separate dimensions."""
    _calls(spark, sf).createOrReplaceTempView("__calls")
    return spark.sql("select source, endpoint, ok, count(*) as n from __calls group by grouping sets ((source, ok), (endpoint, ok), (source, endpoint, ok))")


@query(f"""with {_CALLS}, h as (select source, count(*) as n, avg(cast(not ok as int)) as error_rate, quantile_cont(latency, 0.5) as p50, quantile_cont(latency, 0.95) as p95, strftime(max(ts) filter (ok), '%Y-%m-%d %H:%M:%S') as last_ok from calls where ts >= timestamp '2024-01-20' group by 1)
select *, case when error_rate > 0.2 then 'DOWN' when error_rate > 0.1 then 'DEGRADED' else 'UP' end as state from h""")
def source_health(spark, sf):
    """AGG18 and AGG24: calls, error rate, latency quantiles and state over a window."""
    h = _calls(spark, sf).where("ts >= timestamp '2024-01-20'").groupBy("source").agg(F.count("*").alias("n"), F.avg((~F.col("ok")).cast("int")).alias("error_rate"), F.percentile("latency", 0.5).alias("p50"), F.percentile("latency", 0.95).alias("p95"), F.date_format(F.max(F.when(F.col("ok"), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_ok"))
    return h.withColumn("state", F.when(F.col("error_rate") > 0.2, "DOWN").when(F.col("error_rate") > 0.1, "DEGRADED").otherwise("UP"))


@query(f"""with {_CALLS}, hours as (select unnest(generate_series((select date_trunc('hour', min(ts)) from calls), (select date_trunc('hour', max(ts)) from calls), interval 1 hour)) as h), c as (select date_trunc('hour', ts) as h, count(*) filter (ok) as good, count(*) as n from calls group by 1),
x as (select hours.h, coalesce(good, 0) as good, coalesce(n, 0) as n from hours left join c using (h)) select count(*) as hours_n, count(*) filter (good > 0) as served, cast(sum(n - good) as bigint) as failed, cast(sum(n - good) as double) / sum(n) / 0.1 as budget_used, case when cast(sum(n - good) as double) / sum(n) > 0.1 then 'BREACHED' else 'MET' end as state from x""")
def objectives(spark, sf):
    """AGG19: hourly availability over a spine of hours and the error budget."""
    c = _calls(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.sum(F.col("ok").cast("long")).alias("good"), F.count("*").alias("n"))
    spine = c.agg(F.min("h").alias("a"), F.max("h").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("h"))
    x = spine.join(c, "h", "left").fillna(0, ["good", "n"])
    used = F.sum(F.col("n") - F.col("good")).cast("double") / F.sum("n")
    return x.agg(F.count("*").alias("hours_n"), F.sum((F.col("good") > 0).cast("long")).alias("served"), F.sum(F.col("n") - F.col("good")).alias("failed"), (used / 0.1).alias("budget_used"), F.when(used > 0.1, "BREACHED").otherwise("MET").alias("state"))


@query(f"""with {_CALLS}, g as (select source, endpoint, ts, floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by source, endpoint order by ts, event_id))) as gap from calls) select source, endpoint, count(*) as gaps, cast(max(gap) as bigint) as longest from g where gap > 7200 group by 1, 2""")
def beat_gaps(spark, sf):
    """WIN14 and STR8: gaps between beats over a limit."""
    w = Window.partitionBy("source", "endpoint").orderBy("ts", "event_id")
    g = _calls(spark, sf).withColumn("gap", F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w)))
    return g.where("gap > 7200").groupBy("source", "endpoint").agg(F.count("*").alias("gaps"), F.max("gap").alias("longest"))


@query("""with f as (select l_returnflag as pool, unnest(['l_quantity', 'l_discount', 'l_tax']) as feature, unnest([case when l_orderkey % 11 <> 0 then l_quantity end, case when l_discount > 0.01 then l_discount end, l_tax]) as value from lineitem)
select pool, feature, count(*) as n, count(value) as available, count(*) - count(value) as missing, cast(count(value) as double) / count(*) >= 0.85 as passes from f group by 1, 2""")
def feature_availability(spark, sf):
    """AGG9 and DRF4: available and missing values by feature, with a rate gate."""
    l = read_table(spark, sf, "lineitem")  # noqa: E741
    wide = l.select(F.col("l_returnflag").alias("pool"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_quantity").cast("double")).alias("l_quantity"), F.when(F.col("l_discount") > 0.01, F.col("l_discount").cast("double")).alias("l_discount"), F.col("l_tax").cast("double").alias("l_tax"))
    long = wide.unpivot("pool", ["l_quantity", "l_discount", "l_tax"], "feature", "value")
    return long.groupBy("pool", "feature").agg(F.count("*").alias("n"), F.count("value").alias("available"), (F.count("*") - F.count("value")).alias("missing"), (F.count("value").cast("double") / F.count("*") >= 0.85).alias("passes"))


@query(f"""with {CONTESTS}, {ENTITY}, t as (select pool, entity_id, count(*) as played, sum(pts) as points, sum(own_n - opp_n) as diff, sum(own_n) as scored from entity_rows group by 1, 2)
select pool, entity_id, played, cast(points as bigint) as points, cast(diff as bigint) as diff, cast(scored as bigint) as scored, row_number() over (partition by pool order by points desc, diff desc, scored desc, entity_id) as place from t""")
def standings(spark, sf):
    """AGG10 and SRT1: points, difference, scored, id."""
    t = entity_rows(contests(spark, sf)).groupBy("pool", "entity_id").agg(F.count("*").alias("played"), F.sum("pts").alias("points"), F.sum(F.col("own_n") - F.col("opp_n")).alias("diff"), F.sum("own_n").alias("scored"))
    order = Window.partitionBy("pool").orderBy(F.col("points").desc(), F.col("diff").desc(), F.col("scored").desc(), "entity_id")
    return t.withColumn("place", F.row_number().over(order).cast("long"))


@query(f"""with {CONTESTS}, {ENTITY}, c as (select pool, entity_id, round(sum(pts * pow(0.8, date_diff('week', season, timestamp '2024-01-29'))), 9) as coef from entity_rows group by 1, 2)
select pool, entity_id, coef, (coef - avg(coef) over (partition by pool)) / stddev_pop(coef) over (partition by pool) as z, (rank() over (partition by pool order by coef) - 1 + count(*) over (partition by pool, coef) / 2.0) / count(*) over (partition by pool) as mid_rank from c""")
def coefficients(spark, sf):
    """AGG11 and WIN15: decayed coefficient, z-score and mid-rank share within the pool."""
    age = F.datediff(F.lit("2024-01-29"), F.to_date("season")) / 7
    c = entity_rows(contests(spark, sf)).groupBy("pool", "entity_id").agg(F.round(F.sum(F.col("pts") * F.pow(F.lit(0.8), age)), 9).alias("coef"))
    w, o = Window.partitionBy("pool"), Window.partitionBy("pool").orderBy("coef")
    mid = (F.rank().over(o) - 1 + F.count("*").over(Window.partitionBy("pool", "coef")) / 2.0) / F.count("*").over(w)
    return c.select("pool", "entity_id", "coef", ((F.col("coef") - F.avg("coef").over(w)) / F.stddev_pop("coef").over(w)).alias("z"), mid.alias("mid_rank"))


@query(f"""{_M}, b as (select contest_id, y, round(avg(p0), 9) as p0, round(avg(p1), 9) as p1, round(avg(p2), 9) as p2, count(distinct case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end) as voices from models group by 1, 2)
select contest_id, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pick, greatest(p0, p1, p2) as p, voices = 1 as agreed, round(least(0.05, greatest(0, (greatest(p0, p1, p2) * 2.6 - 1) / 1.6 / 4)), 4) as stake from b where round(greatest(p0, p1, p2) * 2.6, 9) > 1.05""")
def picks(spark, sf):
    """AGG13: voting models to picks with agreement and a capped fractional Kelly stake."""
    best = lambda a, b, c: F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    cols = [F.col(f"p{i}") for i in range(3)]
    m = models(forecasts(contests(spark, sf))).withColumn("voice", best(*cols))
    b = m.groupBy("contest_id", "y").agg(*[F.round(F.avg(c), 9).alias(f"p{i}") for i, c in enumerate(cols)], F.countDistinct("voice").alias("voices")).withColumn("p", F.greatest(*cols)).where("round(p * 2.6, 9) > 1.05")
    stake = F.least(F.lit(0.05), F.greatest(F.lit(0.0), (F.col("p") * 2.6 - 1) / 1.6 / 4))
    return b.select("contest_id", best(*cols).alias("pick"), "p", (F.col("voices") == 1).alias("agreed"), F.round(stake, 4).alias("stake"))


@query(f"""{_M}, h as (select pool, count(*) as n, sum(cast(case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = y as int)) as hits, avg({_LOSS}) as loss from models where model_id = 1 group by 1)
select pool, n, cast(hits as bigint) as hits, loss, (hits / n + 1.9208 / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n) as low, (hits / n + 1.9208 / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n) as high from h""")
def track_record(spark, sf):
    """AGG15: hits with Wilson intervals and losses by pool."""
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    h = _scored(spark, sf).where("model_id = 1").groupBy("pool").agg(F.count("*").alias("n"), F.sum((pick == F.col("y")).cast("long")).alias("hits"), F.avg("log_loss").alias("loss"))
    r, n = F.col("hits") / F.col("n"), F.col("n")
    half = 1.96 * F.sqrt(r * (1 - r) / n + 0.9604 / n / n)
    return h.select("pool", "n", "hits", "loss", ((r + 1.9208 / n - half) / (1 + 3.8416 / n)).alias("low"), ((r + 1.9208 / n + half) / (1 + 3.8416 / n)).alias("high"))


@query(f"""{_M}, c as (select model_id, greatest(p0, p1, p2) as conf, {_LOSS} as loss, percent_rank() over (partition by model_id order by greatest(p0, p1, p2) desc) as r from models), l(level) as (values (1.0), (0.8), (0.6), (0.4))
select model_id, cast(level as double) as level, count(*) as n, avg(loss) as loss, min(conf) as cut from c join l on r <= level group by 1, 2""")
def selective_curve(spark, sf):
    """AGG17: loss against coverage when only the most confident forecasts count."""
    c = _scored(spark, sf).groupBy("model_id", F.greatest("p0", "p1", "p2").alias("conf")).agg(F.count("*").alias("n"), F.sum("log_loss").alias("loss"))
    w = Window.partitionBy("model_id")
    before = F.sum("n").over(w.orderBy(F.col("conf").desc()).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    c = c.withColumn("r", F.coalesce(F.try_divide(before, F.sum("n").over(w) - 1), F.lit(0.0)))  # the rank of equal values is one
    levels = F.explode(F.filter(F.array(*[F.lit(x) for x in (1.0, 0.8, 0.6, 0.4)]), lambda x: F.col("r") <= x))
    return c.withColumn("level", levels).groupBy("model_id", "level").agg(F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("loss"), F.min("conf").alias("cut"))


@query(f"""{_M}, s as (select contest_id, model_id, {_LOSS} as loss, percent_rank() over (partition by model_id, pool, season order by event_ts, contest_id) as r, greatest(p0, p1, p2) as c, y from models),
e as (select model_id, loss, unnest(list_filter([case when r < 1.0 / 3 then 'early' when r < 2.0 / 3 then 'middle' else 'late' end, case when c > 0.5 then 'confident' end, case when y = 1 then 'draw' end], lambda x: x is not null)) as slice from s) select model_id, slice, count(*) as n, avg(loss) as loss from e group by 1, 2""")
def error_slices(spark, sf):
    """AGG25: losses by slices that may overlap."""
    r = F.percent_rank().over(Window.partitionBy("model_id", "pool", "season").orderBy("event_ts", "contest_id"))
    third = F.when(r < 1.0 / 3, "early").when(r < 2.0 / 3, "middle").otherwise("late")
    s = _scored(spark, sf).withColumn("third", third)
    names = F.array_compact(F.array("third", F.when(F.greatest("p0", "p1", "p2") > 0.5, "confident"), F.when(F.col("y") == 1, "draw")))
    return s.withColumn("slice", F.explode(names)).groupBy("model_id", "slice").agg(F.count("*").alias("n"), F.avg("log_loss").alias("loss"))


@query(f"""{_M}, p as (select pool, avg({_LOSS}) filter (model_id = 1) as a, avg({_LOSS}) filter (model_id = 2) as b, count(*) filter (model_id = 1) as n from models group by 1) select pool, a - b as gain, n, case when n < 1000 then 'INCONCLUSIVE' when a < b - 0.005 then 'WON' when a > b + 0.005 then 'LOST' else 'INCONCLUSIVE' end as verdict from p""")
def promotion_gate(spark, sf):
    """MET12 and AGG26: candidate against champion by pool, with a least number and a least gain."""
    s = _scored(spark, sf)
    mean = lambda m: F.avg(F.when(F.col("model_id") == m, F.col("log_loss")))
    p = s.groupBy("pool").agg(mean(1).alias("a"), mean(2).alias("b"), F.sum((F.col("model_id") == 1).cast("long")).alias("n"))
    gain = F.col("a") - F.col("b")
    return p.select("pool", gain.alias("gain"), "n", F.when(F.col("n") < 1000, "INCONCLUSIVE").when(gain < -0.005, "WON").when(gain > 0.005, "LOST").otherwise("INCONCLUSIVE").alias("verdict"))


_SPLIT = f"{CONTESTS}, s as (select pool as k, left_n + right_n as v, event_ts < {DAY0} as ref, cast(right_n as varchar) as cat from contests)"


@query(f"""with {_SPLIT}, e as (select k, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as ed from s where ref group by 1), b as (select s.k, ref, len(list_filter(ed, lambda x: x < v)) as bin from s join e using (k)),
c as (select e.k, g.bin, count(b.k) filter (b.ref) as a, count(b.k) filter (not b.ref) as z from e cross join range(10) g(bin) left join b on b.k = e.k and b.bin = g.bin group by 1, 2), t as (select k, sum(a) as ta, sum(z) as tz from c group by 1)
select k as pool, sum((greatest(z / tz, 1e-4) - greatest(a / ta, 1e-4)) * ln(greatest(z / tz, 1e-4) / greatest(a / ta, 1e-4))) as psi from c join t using (k) group by 1""")
def drift_psi(spark, sf):
    """DRF1 and DRF5: population stability by pool."""
    c = contests(spark, sf).withColumn("v", (F.col("left_n") + F.col("right_n")).cast("double"))
    return drift.psi(c, "pool", "v", F.col("event_ts") < F.expr(DAY0))


@query(f"""with {_SPLIT}, c as (select k, cat, count(*) filter (ref) as a, count(*) filter (not ref) as b from s group by 1, 2), t as (select *, a / sum(a) over (partition by k) as p, b / sum(b) over (partition by k) as q from c)
select k as pool, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2 as js, case when sum(a) >= 30 and sum(b) >= 30 then 'OK' else 'INSUFFICIENT_DATA' end as status from t group by 1""")
def drift_js(spark, sf):
    """DRF2: Jensen-Shannon divergence of categories with a least number of rows."""
    return drift.jensen_shannon(contests(spark, sf).withColumn("cat", F.col("right_n").cast("string")), "pool", "cat", F.col("event_ts") < F.expr(DAY0), 30)


@query(f"""with {_SPLIT}, c as (select k, v, count(*) filter (ref) as a, count(*) filter (not ref) as b from s group by 1, 2), w as (select k, abs(sum(a) over o / sum(a) over (partition by k) - sum(b) over o / sum(b) over (partition by k)) as d from c window o as (partition by k order by v rows unbounded preceding)) select k as pool, max(d) as ks from w group by 1""")
def drift_ks(spark, sf):
    """DRF3: two-sample Kolmogorov-Smirnov distance."""
    return drift.kolmogorov_smirnov(contests(spark, sf).withColumn("v", F.col("left_n") + F.col("right_n")), "pool", "v", F.col("event_ts") < F.expr(DAY0))


@query(f"""with {CONTESTS}, w as (select pool, cast(date_diff('day', timestamp '2024-01-01', date_trunc('day', event_ts)) // 6 as bigint) as win, avg(left_n) as m, count(*) as n from contests group by 1, 2)
select pool, max(abs(b.m - a.m)) * 1.25 as threshold, count(*) as steps from w a join w b using (pool) where b.win = a.win + 1 group by 1""")
def drift_thresholds(spark, sf):
    """DRF6: alarm thresholds from consecutive windows of history."""
    win = F.floor(F.datediff(F.to_date("event_ts"), F.lit("2024-01-01")) / 6)
    w = contests(spark, sf).groupBy("pool", win.alias("win")).agg(F.avg("left_n").alias("m"))
    nxt = w.select("pool", (F.col("win") - 1).alias("win"), F.col("m").alias("m2"))
    return w.join(nxt, ["pool", "win"]).groupBy("pool").agg((F.max(F.abs(F.col("m2") - F.col("m"))) * 1.25).alias("threshold"), F.count("*").alias("steps"))


@query(f"""with {CONTESTS}, s as (select season, min(event_ts) as first_ts from contests group by 1) select strftime(s.season, '%Y-%m-%d') as fold, count(*) filter (c.season < s.season and c.available_at <= s.first_ts) as train, count(*) filter (c.season < s.season and c.available_at > s.first_ts) as embargoed, count(*) filter (c.season = s.season) as eval
from s, contests c group by 1 having count(*) filter (c.season < s.season and c.available_at <= s.first_ts) >= 500""")
def walk_forward_folds(spark, sf):
    """LKG2 and FIT14: expanding folds with an availability embargo and a least training size, by running counts over seasons."""
    c = contests(spark, sf)
    s = c.groupBy("season").agg(F.min("event_ts").alias("first_ts"), F.count("*").alias("eval"))
    w = Window.orderBy("season")  # one row a season
    s = s.withColumn("earlier", F.coalesce(F.sum("eval").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    later = F.collect_list(F.struct(F.col("season").alias("fold"), "first_ts")).over(w.rowsBetween(1, Window.unboundedFollowing))
    late = c.select("season", "available_at").join(s.select("season", later.alias("later"), F.lead("first_ts").over(w).alias("next_ts")), "season").where("available_at > next_ts")
    close = late.select(F.explode(F.filter("later", lambda x: x.first_ts < F.col("available_at"))).alias("x")).groupBy(F.col("x.fold").alias("fold")).agg(F.count("*").alias("embargoed"))
    out = s.join(close, s["season"] == close["fold"], "left").withColumn("embargoed", F.coalesce("embargoed", F.lit(0)))
    return out.withColumn("train", F.col("earlier") - F.col("embargoed")).where("train >= 500").select(F.date_format("season", "yyyy-MM-dd").alias("fold"), "train", "embargoed", "eval")


@query(f"""with {CONTESTS}, r as (select contest_id, case when season < timestamp '2024-01-15' then 'DEV' when season < timestamp '2024-01-22' then 'GUARD' else 'HOLDOUT' end as role from contests) select role, count(*) as n, min(contest_id) as first_id, (select count(*) from r a join r b using (contest_id) where a.role = 'DEV' and b.role = 'HOLDOUT') as shared from r group by 1""")
def season_roles(spark, sf):
    """LKG1, SET2, AGG23: roles of seasons, and the check that roles share no id."""
    role = F.when(F.col("season") < F.expr(DAY0), "DEV").when(F.col("season") < F.expr("timestamp '2024-01-22'"), "GUARD").otherwise("HOLDOUT")
    r = contests(spark, sf).select("contest_id", role.alias("role"))
    shared = r.where("role = 'DEV'").select("contest_id").intersect(r.where("role = 'HOLDOUT'").select("contest_id")).agg(F.count("*").alias("shared"))
    return r.groupBy("role").agg(F.count("*").alias("n"), F.min("contest_id").alias("first_id")).join(F.broadcast(shared))


@query(f"""with {CONTESTS}, {FORECASTS}, m as (select f.contest_id, case when f.cutoff >= f.event_ts then 'late_cutoff' when f.available_at < f.event_ts then 'known_before_event' when f.contest_id % 501 = 0 then 'price_after_event' end as fault from forecasts f) select fault, count(*) as n, min(contest_id) as first_id from m where fault is not null group by 1""")
def clock_gates(spark, sf):
    """LKG6 and LKG7: two-clock gates on forecasts, counted by fault."""
    f = forecasts(contests(spark, sf))
    fault = tables.first_reason({"late_cutoff": F.col("cutoff") >= F.col("event_ts"), "known_before_event": F.col("available_at") < F.col("event_ts"), "price_after_event": F.col("contest_id") % 501 == 0})
    return f.select("contest_id", fault.alias("fault")).where("fault is not null").groupBy("fault").agg(F.count("*").alias("n"), F.min("contest_id").alias("first_id"))


@query(f"""with {CONTESTS}, {ENTITY}, e as (select *, greatest(event_ts, available_at) as seen from entity_rows) select entity_id, count(*) as n, strftime(max(seen), '%Y-%m-%d %H:%M:%S') as last_seen, count(*) filter (seen > timestamp '2024-01-20') as after_cut from e group by 1""")
def row_lineage(spark, sf):
    """LKG8 and AGG21: latest source time of what an entity's row was made from."""
    e = entity_rows(contests(spark, sf)).withColumn("seen", F.greatest("event_ts", "available_at"))
    return e.groupBy("entity_id").agg(F.count("*").alias("n"), F.date_format(F.max("seen"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.sum((F.col("seen") > F.expr("timestamp '2024-01-20'")).cast("long")).alias("after_cut"))


@query("""select o_custkey, o_orderkey, o_orderstatus from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) where p is null or p <> o_orderstatus""")
def newest_changed(spark, sf):
    """STR5 (batch form): observations stored only when they changed."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read_table(spark, sf, "orders").withColumn("p", F.lag("o_orderstatus").over(w)).where("p is null or p <> o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("""with b as (select o_custkey, o_orderkey, o_orderdate, list_sort(list_distinct(list(l_partkey))) as parts from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3),
p as (select *, lag(parts) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from b) select o_orderkey, cast(len(parts) as bigint) as n, cast(len(list_filter(parts, lambda x: not list_contains(before, x))) as bigint) as added, cast(len(list_filter(before, lambda x: not list_contains(parts, x))) as bigint) as dropped from p where before is not null""")
def basket_changes(spark, sf):
    """WIN11 (in part) and SRC9: change of a set against the one before."""
    b = read_table(spark, sf, "orders").join(read_table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    p = b.withColumn("before", F.lag("parts").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before is not null")
    size = lambda c: F.size(c).cast("long")
    return p.select("o_orderkey", size("parts").alias("n"), size(F.array_except("parts", "before")).alias("added"), size(F.array_except("before", "parts")).alias("dropped"))


@query(f"""with {CONTESTS}, {ENTITY}, r as (select entity_id, contest_id, row_number() over (partition by entity_id order by event_ts desc, contest_id desc) as k from entity_rows) select entity_id, contest_id, k as rank from r where k <= 5""")
def recent_n(spark, sf):
    """WIN17 and SRT3: the most recent n of each entity."""
    return tables.top_n(entity_rows(contests(spark, sf)), ["entity_id"], [F.col("event_ts").desc(), F.col("contest_id").desc()], 5).select("entity_id", "contest_id", F.col("rank").cast("long"))


@query(f"""with {CONTESTS} select least(left_id, right_id) as a, greatest(left_id, right_id) as b, count(*) as met, count(*) filter ((left_n > right_n) = (left_id < right_id) and left_n <> right_n) as won_a from contests group by 1, 2""")
def head_to_head(spark, sf):
    """WIN17: meetings of an unordered pair."""
    won = ((F.col("left_n") > F.col("right_n")) == (F.col("left_id") < F.col("right_id"))) & (F.col("left_n") != F.col("right_n"))
    return contests(spark, sf).groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(F.count("*").alias("met"), F.sum(won.cast("long")).alias("won_a"))


@query(f"""with {CONTESTS}, s as (select contest_id, 'stage' || g as stage, g, 0.3 + (contest_id * (g + 3)) % 17 / cast(40 as double) as p from contests, range(4) r(g)), d as (select contest_id, stage, p - lag(p) over (partition by contest_id order by g) as d from s) select contest_id, max(abs(d)) as largest, sum(d) as drift_sum from d group by 1""")
def stage_deltas(spark, sf):
    """WIN13 and MET14: change between stages."""
    s = contests(spark, sf).select("contest_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g")).withColumn("p", F.lit(0.3) + (F.col("contest_id") * (F.col("g") + 3)) % 17 / F.lit(40.0))
    d = s.withColumn("d", F.col("p") - F.lag("p").over(Window.partitionBy("contest_id").orderBy("g")))
    return d.groupBy("contest_id").agg(F.max(F.abs("d")).alias("largest"), F.sum("d").alias("drift_sum"))
