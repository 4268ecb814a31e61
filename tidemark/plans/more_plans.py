"""Further table jobs: ledgers of decisions, labels, availability blocks, reference scores, audits by perturbation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grids
from tidemark.operators import cleaning, tables
from tidemark.operators.asof import as_of, last_state
from tidemark.operators.resampling import block_bootstrap, permutation_p
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _BRIER, _LOSS, _M, _RATES, _TRIPLE, _rates, _scored, _triples
from tidemark.plans.table_plans import _ALIASES, _NORM, RAW, aliases, raw
from tidemark.sources.tables import CONTESTS, ENTITY, FORECASTS, contests, entity_rows, forecasts, models, read_table

query = Registry()


@query(f"""{_M}, d as (select contest_id, model_id, event_ts, y, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as pick, round(greatest(p0, p1, p2), 9) as p from models where greatest(p0, p1, p2) > 0.42),
f as (select * from d qualify row_number() over (partition by contest_id order by model_id) = 1) select model_id, count(*) as n, cast(sum(cast(pick = y as int)) as bigint) as won, sum(case when pick = y then 1.2 else -1.0 end) / count(*) as roi, avg(p) as stated, case when count(*) < 100 then 'too_few' else 'ok' end as note from f group by 1""")
def paper_ledger(spark, sf):
    """AGG14: the first decision stands, is settled, and summed up with a note on reliability."""
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    d = models(forecasts(contests(spark, sf))).where("greatest(p0, p1, p2) > 0.42").withColumns({"pick": pick, "p": F.round(F.greatest("p0", "p1", "p2"), 9)})
    f = tables.top_n(d, ["contest_id"], [F.col("model_id")], 1).withColumn("hit", (F.col("pick") == F.col("y")).cast("long"))
    return f.groupBy("model_id").agg(F.count("*").alias("n"), F.sum("hit").alias("won"), (F.sum(F.when(F.col("hit") == 1, 1.2).otherwise(-1.0)) / F.count("*")).alias("roi"), F.avg("p").alias("stated"), F.when(F.count("*") < 100, "too_few").otherwise("ok").alias("note"))


_WILSON = "(h / n + 1.9208 / n {s} 1.96 * sqrt(h / n * (1 - h / n) / n + 0.9604 / n / n)) / (1 + 3.8416 / n)"


@query(f"""{_M}, l as (select case when greatest(p0, p1, p2) > 0.55 then 'strong' when greatest(p0, p1, p2) > 0.45 then 'lean' else 'open' end as label, pool, greatest(p0, p1, p2) as p, cast(case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = y as int) as hit from models where model_id = 1),
g as (select label, pool, count(*) as n, sum(hit) as h, avg(p) as stated from l group by grouping sets ((label, pool), (label)))
select label, pool, n, stated, h / n as seen, case when stated > {_WILSON.format(s='+')} then 'OVERSTATES' when stated < {_WILSON.format(s='-')} then 'UNDERSTATES' else 'CONSISTENT' end as verdict from g""")
def label_reliability(spark, sf):
    """AGG16: stated probability of labels against the interval of what was seen, by pool and overall."""
    top = F.greatest("p0", "p1", "p2")
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    l = models(forecasts(contests(spark, sf))).where("model_id = 1").select(F.when(top > 0.55, "strong").when(top > 0.45, "lean").otherwise("open").alias("label"), "pool", top.alias("p"), (pick == F.col("y")).cast("int").alias("hit"))  # noqa: E741
    both = l.groupBy("label", "pool").agg(F.count("*").alias("n"), F.sum("hit").alias("h"), F.sum("p").alias("s"))
    both = both.unionByName(both.groupBy("label").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("s").alias("s")).withColumn("pool", F.lit(None).cast("string")))
    r, n, stated = F.col("h") / F.col("n"), F.col("n"), F.col("s") / F.col("n")
    half, mid, over = 1.96 * F.sqrt(r * (1 - r) / n + 0.9604 / n / n), r + 1.9208 / n, 1 + 3.8416 / n
    verdict = F.when(stated > (mid + half) / over, "OVERSTATES").when(stated < (mid - half) / over, "UNDERSTATES").otherwise("CONSISTENT")
    return both.select("label", "pool", "n", stated.alias("stated"), r.alias("seen"), verdict.alias("verdict"))


@query("""with t as (select o_orderkey, case o_orderkey % 6 when 0 then 'League Stage - 4' when 1 then 'Knockout Round Play-offs' when 2 then 'Semi-finals' when 3 then 'Final' when 4 then 'Round of 16, 2nd leg' else 'Exhibition' end as stage from orders)
select o_orderkey, lower(stage) like 'league%' as league_phase, regexp_matches(lower(stage), 'play-?off') as playoff, regexp_matches(lower(stage), 'knockout|round of|semi|quarter') as knockout, regexp_matches(lower(stage), '^final$') as final, regexp_matches(lower(stage), 'leg') as two_legged, try_cast(regexp_extract(stage, ' - ([0-9]+)', 1) as int) as matchday, stage = 'Exhibition' as unmatched from t""")
def stage_flags(spark, sf):
    """CLN14: free-text stages to flags; texts that set none are marked."""
    k = F.col("o_orderkey") % 6
    stage = F.when(k == 0, "League Stage - 4").when(k == 1, "Knockout Round Play-offs").when(k == 2, "Semi-finals").when(k == 3, "Final").when(k == 4, "Round of 16, 2nd leg").otherwise("Exhibition")
    t = read_table(spark, sf, "orders").select("o_orderkey", stage.alias("stage")).withColumn("s", F.lower("stage"))
    flags = {"league_phase": F.col("s").startswith("league"), "playoff": F.col("s").rlike("play-?off"), "knockout": F.col("s").rlike("knockout|round of|semi|quarter"), "final": F.col("s").rlike("^final$"), "two_legged": F.col("s").rlike("leg")}
    none = ~F.greatest(*[c.cast("int") for c in flags.values()]).cast("boolean")
    return t.select("o_orderkey", *[c.alias(n) for n, c in flags.items()], F.regexp_extract("stage", " - ([0-9]+)", 1).try_cast("int").alias("matchday"), none.alias("unmatched"))


@query(f"""with {_TRIPLE}, m as (select contest, coalesce(max(case when maker = 2 then a end), max(case when maker = 4 then a end), max(case when maker = 0 then a end)) as price, case when max(case when maker = 2 then 1 end) = 1 then 'maker2' when max(case when maker = 4 then 1 end) = 1 then 'maker4' when max(case when maker = 0 then 1 end) = 1 then 'maker0' else 'none' end as source from t group by 1)
select source, count(*) as n, coalesce(avg(price), 0) as mean_price from m group by 1""")
def preferred_source(spark, sf):
    """CLN18 and JN16: the first available source in order of preference, and how often each was used."""
    of = lambda m: F.max(F.when(F.col("maker") == m, F.col("a")))
    m = _triples(spark, sf).groupBy("contest").agg(F.coalesce(of(2), of(4), of(0)).alias("price"), F.when(of(2).isNotNull(), "maker2").when(of(4).isNotNull(), "maker4").when(of(0).isNotNull(), "maker0").otherwise("none").alias("source"))
    return m.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.avg("price"), F.lit(0.0)).alias("mean_price"))


@query(f"""with {CONTESTS}, {ENTITY}, h as (select entity_id, sum(pow(0.5, date_diff('day', date_trunc('day', event_ts), timestamp '2024-02-01') / 30.0)) as w from entity_rows group by 1)
select contest_id, array_to_string(list_sort(list_filter([case when l.w < 50 or r.w < 50 then 'thin_history' end, case when abs(l.w - r.w) > 8 then 'uneven_history' end, case when contest_id % 50 = 0 then 'low_confidence' end], lambda x: x is not null)), ',') as flags from contests left join h l on left_id = l.entity_id left join h r on right_id = r.entity_id""")
def quality_flags(spark, sf):
    """CLN21 and WIN15: flags by half-life weights of the histories of both entities."""
    age = F.datediff(F.lit("2024-02-01"), F.to_date("event_ts"))
    c = contests(spark, sf)
    h = entity_rows(c).groupBy("entity_id").agg(F.sum(F.pow(F.lit(0.5), age / 30.0)).alias("w"))
    out = c.join(h.select(F.col("entity_id").alias("left_id"), F.col("w").alias("lw")), "left_id", "left").join(h.select(F.col("entity_id").alias("right_id"), F.col("w").alias("rw")), "right_id", "left")
    flags = F.array(F.when((F.col("lw") < 50) | (F.col("rw") < 50), "thin_history"), F.when(F.abs(F.col("lw") - F.col("rw")) > 8, "uneven_history"), F.when(F.col("contest_id") % 50 == 0, "low_confidence"))
    return out.select("contest_id", F.array_join(F.sort_array(F.array_compact(flags)), ",").alias("flags"))


@query(f"""with {_ALIASES}, a as (select distinct {_NORM.format(c="raw_name")} as norm, target from aliases), u as (select norm, min(target) as target from a group by 1 having count(*) = 1), n as (select distinct {_NORM.format(c="raw_name")} as norm from aliases)
select n.norm, u.target, case when u.target is null then 'conflict' else 'unique' end as status from n left join u using (norm)""")
def unique_names(spark, sf):
    """RES3 and RES9: names that lead to one target only; the rest are proposals with a conflict."""
    a = aliases(spark, sf).select(cleaning.normal_name(F.col("raw_name")).alias("norm"), "target").distinct()
    g = a.groupBy("norm").agg(F.count("*").alias("n"), F.min("target").alias("t"))
    return g.select("norm", F.when(F.col("n") == 1, F.col("t")).alias("target"), F.when(F.col("n") == 1, "unique").otherwise("conflict").alias("status"))


@query(f"""with {CONTESTS}, {ENTITY}, s as (select event_id as obs, user_id as person, user_id % 50 as entity, ts as seen from events where event_type = 'error')
select e.contest_id, e.side, count(distinct case when seen <= cutoff then person end) as known_persons, count(case when seen > cutoff then 1 end) as excluded from entity_rows e left join s on e.entity_id = s.entity and seen between e.event_ts - interval 6 hour and e.event_ts group by 1, 2""")
def availability_block(spark, sf):
    """JN7 and JN14: status rows of an entity near the event, those seen after the cutoff counted as excluded. Both sides go into six-hour buckets, so the join is by equality."""
    e = entity_rows(contests(spark, sf))
    s = read_table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("person"), (F.col("user_id") % 50).alias("entity_id"), F.col("ts").alias("seen"))
    bucket = lambda c: F.floor(F.unix_seconds(c) / 21600)
    near = e.select("contest_id", "side", "entity_id", "event_ts", "cutoff", F.explode(F.array(bucket("event_ts"), bucket("event_ts") - 1)).alias("b")).join(s.withColumn("b", bucket("seen")), ["entity_id", "b"])
    near = near.where("seen <= event_ts and seen >= event_ts - interval 6 hours").groupBy("contest_id", "side").agg(F.countDistinct(F.when(F.col("seen") <= F.col("cutoff"), F.col("person"))).alias("known_persons"), F.sum((F.col("seen") > F.col("cutoff")).cast("long")).alias("excluded"))
    return e.select("contest_id", "side").join(near, ["contest_id", "side"], "left").fillna(0, ["known_persons", "excluded"])


@query(f"""with {CONTESTS}, {_RATES.replace("rates as", "r0 as")}, r as (select contest_id, x * (90 - 30) / 90 as x, y * (90 - 30) / 90 as y from r0), g as (select contest_id, h, a, exp(-x) * pow(x, h) / [1, 1, 2, 6, 24, 120, 720, 5040][h + 1] * exp(-y) * pow(y, a) / [1, 1, 2, 6, 24, 120, 720, 5040][a + 1] as p from r, range(8) k(h), range(8) m(a))
select contest_id, sum(p) filter (1 + h > a) / sum(p) as p_left, sum(p) filter (1 + h = a) / sum(p) as p_draw from g group by 1""")
def in_play(spark, sf):
    """PRB8: chances at minute 30 with the left side one ahead, from the rates of the time that is left."""
    r = _rates(spark, sf).select("contest_id", (F.col("x") * 60 / 90).alias("x"), (F.col("y") * 60 / 90).alias("y"))
    head = lambda c: F.slice(grids.poisson_pmf(F.col(c), 8), 1, 8)

    def own(rates: DataFrame) -> DataFrame:
        g = rates.withColumn("g", grids.score_grid(head("x"), head("y")))
        return g.select("x", "y", grids.region(F.col("g"), lambda h, a: h + 1 > a).alias("p_left"), grids.region(F.col("g"), lambda h, a: h + 1 == a).alias("p_draw"))

    return tables.once_per(r, ["x", "y"], own).select("contest_id", "p_left", "p_draw")


@query(f"""{_M}, l as (select contest_id, model_id, unnest(['log_loss', 'brier', 'abs_first']) as target, unnest([{_LOSS}, {_BRIER}, abs(p0 - cast(y = 0 as int))]) as v from models)
select target, avg(v) filter (model_id = 1) as model, avg(v) filter (model_id = 2) as baseline, avg(v) filter (model_id = 1) < avg(v) filter (model_id = 2) as better from l group by 1""")
def model_vs_baseline(spark, sf):
    """MET13 and MET16: model against baseline over many targets."""
    s = _scored(spark, sf).withColumn("abs_first", F.abs(F.col("p0") - (F.col("y") == 0).cast("int"))).unpivot(["contest_id", "model_id"], ["log_loss", "brier", "abs_first"], "target", "v")
    mean = lambda m: F.avg(F.when(F.col("model_id") == m, F.col("v")))
    return s.groupBy("target").agg(mean(1).alias("model"), mean(2).alias("baseline"), (mean(1) < mean(2)).alias("better"))


@query(f"""with {CONTESTS}, o as (select pool, left_n, right_n, row_number() over (partition by pool order by event_ts, contest_id) as k, count(*) over (partition by pool) as n from contests), s as (select pool, unnest(list_filter(['all', case when k <= 100 then 'first' end, case when k > n - 100 then 'last' end], lambda x: x is not null)) as part, left_n, right_n from o)
select pool, part, count(*) as n, avg(cast(left_n > right_n as int)) as always_left, avg(cast(left_n = right_n as int)) as always_draw, avg(cast(left_n + right_n > 2.5 as int)) as over_rate from s group by 1, 2""")
def naive_rates(spark, sf):
    """MET15: rates of naive strategies over the first, the last and all contests."""
    w = Window.partitionBy("pool")
    o = contests(spark, sf).withColumns({"k": F.row_number().over(w.orderBy("event_ts", "contest_id")), "n": F.count("*").over(w)})
    part = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("k") <= 100, "first"), F.when(F.col("k") > F.col("n") - 100, "last"))))
    rate = lambda c: F.avg(c.cast("int"))
    s = o.select("pool", "left_n", "right_n", part.alias("part"))
    return s.groupBy("pool", "part").agg(F.count("*").alias("n"), rate(F.col("left_n") > F.col("right_n")).alias("always_left"), rate(F.col("left_n") == F.col("right_n")).alias("always_draw"), rate(F.col("left_n") + F.col("right_n") > 2.5).alias("over_rate"))


@query(f"""with {RAW} select id, array_to_string(list_sort(list_filter([case when member is null then 'member' end, case when day_text = 'n/a' then 'day' end, case when count_text = '' then 'count' end], lambda x: x is not null)), ',') as missing from raw where member is null or day_text = 'n/a' or count_text = ''""")
def missing_provenance(spark, sf):
    """V04: rows that lack a required field, with the fields."""
    missing = F.array_compact(F.array(F.when(F.col("member").isNull(), "member"), F.when(F.col("day_text") == "n/a", "day"), F.when(F.col("count_text") == "", "count")))
    return raw(spark, sf).where(F.size(missing) > 0).select("id", F.array_join(F.sort_array(missing), ",").alias("missing"))


@query("""select l_orderkey, count(*) as n, count(*) filter (l_quantity is null or l_discount > 0.09) as invalid, arg_min(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as first_value, case when count(*) filter (l_discount <= 0.09) = 0 then 'MISSING' else 'OBSERVED' end as status from lineitem group by 1""")
def earliest_observation(spark, sf):
    """SRC8: optional measures; the earliest observation of a key stands, invalid ones are counted."""
    ok = F.col("l_discount") <= 0.09
    order = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum((~ok | F.col("l_quantity").isNull()).cast("long")).alias("invalid"), F.min_by("l_quantity", order).alias("first_value"), F.when(F.sum(ok.cast("long")) == 0, "MISSING").otherwise("OBSERVED").alias("status"))


@query("""with h as (select sha256('{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}') as h from customer),
d as (select sha256(concat_ws(':', count(*), """ + ", ".join(f"sum(cast(cast('0x' || substr(h, {16 * k + 1}, 16) as ubigint) as hugeint))" for k in range(4)) + """)) as digest from h) select c_nationkey, count(*) as n, any_value(digest) as digest from customer, d group by 1""")
def mapping_digest(spark, sf):
    """V05, V09, LKG10: canonical lines of a mapping and a digest that does not depend on their order."""
    m = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return m.groupBy("c_nationkey").agg(F.count("*").alias("n")).crossJoin(F.broadcast(tables.table_digest(m)))


def form_features(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """The feature job that the perturbation audit runs: mean points of what is known at the cutoff."""
    order = Window.partitionBy("entity_id").orderBy("available_at", "contest_id").rowsBetween(-4, 0)
    state = last_state(rows.withColumn("form", F.avg("pts").over(order)), ["entity_id"], "available_at", ["contest_id"])
    return as_of(asks, state, ["entity_id"], "cutoff", "available_at", ["form"]).select("contest_id", "side", F.round("form", 9).alias("form"))


def perturbation_audit(rows: DataFrame, at: F.Column, features=form_features) -> DataFrame:
    """LKG4, EXT2: features of asks up to a point, with all outcomes not yet known at it scrambled; a row that changes is a leak."""
    asks = rows.where(F.col("cutoff") <= at).select("contest_id", "side", "entity_id", "cutoff")
    scrambled = rows.withColumn("pts", F.when(F.col("available_at") > at, F.col("pts") * -7 + 3).otherwise(F.col("pts")))
    return features(rows, asks).exceptAll(features(scrambled, asks))


@query(f"""with {CONTESTS}, {ENTITY} select pool, count(*) as asks, 0 as leaks from entity_rows where cutoff <= timestamp '2024-01-15' group by 1""")
def leak_audit(spark, sf):
    """LKG4: the perturbation audit of the form feature; by pool, asks and leaks."""
    rows = entity_rows(contests(spark, sf))
    at = F.expr("timestamp '2024-01-15'")
    leaks = perturbation_audit(rows, at).join(rows.select("contest_id", "side", "pool"), ["contest_id", "side"]).groupBy("pool").agg(F.count("*").alias("leaks"))
    return rows.where(F.col("cutoff") <= at).groupBy("pool").agg(F.count("*").alias("asks")).join(leaks, "pool", "left").select("pool", "asks", F.coalesce("leaks", F.lit(0)).alias("leaks"))


@query(f"""with {CONTESTS}, {FORECASTS}, d as (select contest_id, y, count(*) filter (left_n is not null and right_n is not null) over () as whole_n, contest_id % 3 <> 0 as observed from forecasts join contests using (contest_id)) select count(*) as eligible, count(*) filter (observed) as observed_n, max(whole_n) as complete, count(*) filter (observed) >= 500 as enough from d""")
def denominators(spark, sf):
    """AGG27 and AGG28: denominators of an optional source and its gate."""
    c = contests(spark, sf)
    d = forecasts(c).select("contest_id").join(c, "contest_id")
    seen = F.sum((F.col("contest_id") % 3 != 0).cast("long"))
    return d.agg(F.count("*").alias("eligible"), seen.alias("observed_n"), F.sum((F.col("left_n").isNotNull() & F.col("right_n").isNotNull()).cast("long")).alias("complete"), (seen >= 500).alias("enough"))


@query()
def window_comparison(spark, sf):
    """MET8: losses of two windows compared by resampling their weekly blocks apart."""
    s = _scored(spark, sf).where("model_id = 1").withColumn("block", F.to_date("event_ts"))
    early, late = s.where("event_ts < timestamp '2024-01-15'"), s.where("event_ts >= timestamp '2024-01-15'")
    a, b = (block_bootstrap(w, "block", ["log_loss"], 300, seed).select(F.lit(name).alias("part"), "mean", "low", "high") for w, seed, name in ((early, 1, "early"), (late, 2, "late")))
    return a.unionByName(b)


@query()
def permutation_test(spark, sf):
    """MET9: is the mean count of the left side another one in the later half?"""
    return permutation_p(contests(spark, sf).withColumn("late", F.col("event_ts") >= F.expr("timestamp '2024-01-15'")).withColumn("v", F.col("left_n").cast("double")), "v", "late")


@query()
def calibration_null(spark, sf):
    """MET10: calibration error of the top label against that of a forecaster who is right as often as stated, outcomes drawn by hash."""
    m = models(forecasts(contests(spark, sf))).where("model_id = 1").withColumns({"c": F.greatest("p0", "p1", "p2"), "hit": (F.get(F.array("p0", "p1", "p2"), F.col("y")) == F.greatest("p0", "p1", "p2")).cast("double")})
    bin_ = F.least(F.lit(9), F.floor((F.col("c") - 1.0 / 3) / (2.0 / 3) * 10))
    draws = 50
    u = (F.pmod(F.xxhash64(F.lit(5), "contest_id", "draw"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    many = m.withColumn("bin", bin_).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("h", F.when(F.col("draw") == 0, F.col("hit")).otherwise((u < F.col("c")).cast("double")))
    ece = many.groupBy("draw", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("c") - F.avg("h")).alias("g")).groupBy("draw").agg((F.sum(F.col("n") * F.col("g")) / F.sum("n")).alias("ece"))
    return ece.agg(F.max(F.when(F.col("draw") == 0, F.col("ece"))).alias("seen"), F.percentile(F.when(F.col("draw") > 0, F.col("ece")), 0.95).alias("null_95"))


@query(f"""{_M} select model_id, case when event_ts < timestamp '2024-01-15' then 'fit' else 'test' end as part, count(*) as n, avg({_LOSS}) as log_loss, avg({_BRIER}) as brier, avg(p0) as mean_stated, avg(cast(y = 0 as int)) as rate from models group by 1, 2""")
def metric_summary(spark, sf):
    """MET17: metrics by window and model."""
    s = _scored(spark, sf).withColumn("part", F.when(F.col("event_ts") < F.expr("timestamp '2024-01-15'"), "fit").otherwise("test"))
    return s.groupBy("model_id", "part").agg(F.count("*").alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"), F.avg("p0").alias("mean_stated"), F.avg((F.col("y") == 0).cast("int")).alias("rate"))


@query(f"""{_M}, w as (select model_id, case when event_ts < timestamp '2024-01-12' then 'fit' when event_ts < timestamp '2024-01-20' then 'select' else 'test' end as part, {_LOSS} as l from models),
s as (select model_id, avg(l) filter (part = 'fit') as fit_loss, avg(l) filter (part = 'select') as select_loss, avg(l) filter (part = 'test') as test_loss from w group by 1) select *, row_number() over (order by select_loss, model_id) = 1 as chosen from s""")
def select_and_test(spark, sf):
    """FIT15: candidates compared on a selection window; the chosen one's test loss is read once."""
    part = F.when(F.col("event_ts") < F.expr("timestamp '2024-01-12'"), "fit").when(F.col("event_ts") < F.expr("timestamp '2024-01-20'"), "select").otherwise("test")
    s = _scored(spark, sf).withColumn("part", part)
    loss = lambda p: F.avg(F.when(F.col("part") == p, F.col("log_loss"))).alias(f"{p}_loss")
    out = s.groupBy("model_id").agg(loss("fit"), loss("select"), loss("test"))
    return out.withColumn("chosen", F.row_number().over(Window.orderBy("select_loss", "model_id")) == 1)


@query("""with r as (select event_id, event_type as lic, user_id, case when event_id % 101 = 0 then null else event_id end as key from events) select 'malformed' as rule, count(*) as n, case when count(*) > 0 then 'warn' else 'ok' end as severity from r where key is null
union all select 'licence', count(*), case when count(*) > 0 then 'block' else 'ok' end from r where lic = 'error' union all select 'conflict', count(*), case when count(*) > 0 then 'block' else 'ok' end from (select key from r where key is not null group by 1 having count(*) > 1)""")
def record_checks(spark, sf):
    """AGG22: checks of stored records as alert rows."""
    r = read_table(spark, sf, "events").select(F.col("event_type").alias("lic"), F.when(F.col("event_id") % 101 != 0, F.col("event_id")).alias("key"))
    row = lambda rule, d, bad: d.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n", F.when(F.col("n") > 0, bad).otherwise("ok").alias("severity"))
    out = row("malformed", r.where("key is null"), "warn").unionByName(row("licence", r.where("lic = 'error'"), "block"))
    return out.unionByName(row("conflict", r.where("key is not null").groupBy("key").count().where("count > 1"), "block"))
