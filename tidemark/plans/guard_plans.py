"""Guards, plug-ins, snapshots of a stage, and the value and settlement run."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import cleaning, guards, tables
from tidemark.operators.asof import as_of, last_state
from tidemark.operators.features import running
from tidemark.plans.asof_plans import _STAGES, _STAGES_SQL
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _LOSS, _M, _scored
from tidemark.sources.tables import CONTESTS, ENTITY, FORECASTS, MODELS, QUOTES, contests, entity_rows, forecasts, models, quotes, read_table

query = Registry()

_WALL = """w as (select o_orderkey, case o_orderkey % 3 when 0 then date '1998-10-25' when 1 then date '1998-03-29' else cast(o_orderdate as date) end + to_hours(cast(o_orderkey // 3 % 5 as int)) + to_minutes(cast(o_orderkey * 7 % 60 as int)) as wall,
    case o_orderkey // 15 % 3 when 0 then 'Europe/Berlin' when 1 then 'America/New_York' else 'Australia/Lord_Howe' end as zone from orders)"""
_FROM = "timezone(zone, timezone('UTC', {t}))"


@query(f"""with {_WALL}, o as (select *, {_FROM.format(t="wall - interval 1 day")} - (wall - interval 1 day) as before, {_FROM.format(t="wall + interval 1 day")} - (wall + interval 1 day) as after from w),
i as (select *, wall - before as a, wall - after as b from o), v as (select *, {_FROM.format(t="a")} = wall as va, {_FROM.format(t="b")} = wall as vb from i)
select o_orderkey, case when not va and not vb then 'gap' when va and vb and a <> b then 'fold' end as reason, strftime(case when va and not (vb and a <> b) then a when vb and not va then b end, '%Y-%m-%d %H:%M') as instant from v""")
def local_times(spark, sf):
    """CLN3: wall times of three zones as instants; those that a zone skips or has twice, by an hour or half of one, have none."""
    key = F.col("o_orderkey")
    day = F.when(key % 3 == 0, F.lit("1998-10-25")).when(key % 3 == 1, F.lit("1998-03-29")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp")
    wall = day + F.make_dt_interval(hours=F.floor(key / 3).cast("int") % 5, mins=(key * 7 % 60).cast("int"))
    zone = F.get(F.array(*[F.lit(z) for z in ("Europe/Berlin", "America/New_York", "Australia/Lord_Howe")]), (F.floor(key / 15) % 3).cast("int"))
    rows = read_table(spark, sf, "orders").select("o_orderkey", wall.alias("wall"), zone.alias("zone"))
    instant, reason = cleaning.local_to_utc(F.col("wall"), F.col("zone"))
    return rows.select("o_orderkey", reason.alias("reason"), F.date_format(instant, "yyyy-MM-dd HH:mm").alias("instant"))


@query(f"""with {CONTESTS} select contest_id, case when contest_id % 4 = 0 then 'observed' else 'inferred' end as source, strftime(case when contest_id % 4 = 0 then event_ts + interval 100 minute else event_ts + interval 3 hour end, '%Y-%m-%d %H:%M:%S') as known_at from contests""")
def inferred_availability(spark, sf):
    """CLN11: the time a result was known, as observed or else inferred by a lag, with a label that says which."""
    seen = contests(spark, sf).withColumn("seen_at", F.when(F.col("contest_id") % 4 == 0, F.col("event_ts") + F.expr("interval 100 minutes")))
    at, source = cleaning.availability("seen_at", "event_ts", F.expr("interval 3 hours"))
    return seen.select("contest_id", source.alias("source"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("known_at"))


_UNTIL, _FROM_TEST = "timestamp '2024-01-15'", "timestamp '2024-01-22'"


@query(f"""with {CONTESTS}, m(mode) as (values ('train'), ('validate'), ('final')), s as (select season, count(*) as n from contests group by 1)
select mode, strftime(season, '%Y-%m-%d') as season, case when season >= {_FROM_TEST} and mode <> 'final' then 'locked' when season >= {_UNTIL} and mode = 'train' then 'outside' else 'allowed' end as verdict, n as rows_n from s, m""")
def season_access(spark, sf):
    """LKG3: what each mode may read of each season. `guards.read_seasons` raises on the others."""
    s = contests(spark, sf).groupBy("season").agg(F.count("*").alias("rows_n")).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("train", "validate", "final")])))
    verdict = guards.season_verdict(F.col("season"), F.col("mode"), F.expr(_UNTIL), F.expr(_FROM_TEST))
    return s.select("mode", F.date_format("season", "yyyy-MM-dd").alias("season"), verdict.alias("verdict"), "rows_n")


@query(f"""with {CONTESTS} select pool, count(*) as rows_n, sum(left_n) as total from contests where season < {_UNTIL} group by 1""")
def guarded_read(spark, sf):
    """LKG3: a training job that reads through the guard."""
    c = contests(spark, sf)
    wanted = c.select("season").distinct().where(f"season < {_UNTIL}")
    return guards.read_seasons(c, "season", wanted, "train", F.expr(_UNTIL), F.expr(_FROM_TEST)).groupBy("pool").agg(F.count("*").alias("rows_n"), F.sum("left_n").alias("total"))


@query("""with r as (select o_orderkey, o_custkey as purpose, o_orderdate as at_ts, case when o_orderkey % 7 <> 0 then o_orderkey end as spec from orders), h as (select distinct o_custkey as purpose from orders where o_custkey % 10 = 0),
n as (select *, row_number() over (partition by purpose, spec is not null order by at_ts, o_orderkey) as n from r)
select o_orderkey, case when spec is null then 'REFUSED_NOT_REGISTERED' when n > 1 or purpose in (select purpose from h) then 'REFUSED_CONSUMED' else 'CONSUMED' end as status from n""")
def holdout_reads(spark, sf):
    """LKG11, LKG9: a holdout is read once for a purpose, and only with a registered spec."""
    o = read_table(spark, sf, "orders")
    requests = o.select("o_orderkey", F.col("o_custkey").alias("purpose"), F.col("o_orderdate").alias("at_ts"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("spec"))
    log = o.where("o_custkey % 10 = 0").select(F.col("o_custkey").alias("purpose"))
    return guards.consume(log, requests, "purpose", "at_ts", "o_orderkey", "spec").select("o_orderkey", "status")


@query("""select p_partkey, concat_ws(',', case when coalesce(p_size % 5 <> 0, false) then null else 'data_version' end, case when coalesce(p_partkey % 7 <> 0, false) then null else 'feature_version' end, case when coalesce(length(p_type) % 2 = 0, false) then null else 'registry_hash' end) as problems from part""")
def stale_tables(spark, sf):
    """V08: stamps of stored tables that differ from what a reader expects. `guards.read_versioned` raises on them."""
    p = read_table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 5 != 0).alias("data_version"), (F.col("p_partkey") % 7 != 0).alias("feature_version"), (F.length("p_type") % 2 == 0).alias("registry_hash"))
    return p.select("p_partkey", guards.version_problems({c: F.lit(True) for c in ("data_version", "feature_version", "registry_hash")}).alias("problems"))


_PRICES = f"""{QUOTES}, each_price as (select contest, maker, outcome, arg_min(price, (observed_at, seq)) as price, arg_max(price, (observed_at, seq)) as closing from quotes group by 1, 2, 3),
triple as (select contest, maker, max(price) filter (outcome = 0) as q0, max(price) filter (outcome = 1) as q1, max(price) filter (outcome = 2) as q2, max(closing) filter (outcome = 0) as z0, max(closing) filter (outcome = 1) as z1, max(closing) filter (outcome = 2) as z2 from each_price group by 1, 2 having count(*) = 3),
best as (select *, 1 / q0 + 1 / q1 + 1 / q2 as over from triple qualify row_number() over (partition by contest order by 1 / q0 + 1 / q1 + 1 / q2, maker) = 1)"""


def best_triples(spark, sf):
    """The maker of least margin with a complete triple for each contest: first prices q, last prices z, and the margin."""
    at = F.struct("observed_at", "seq")
    each = quotes(spark, sf).groupBy("contest", "maker", "outcome").agg(F.min_by("price", at).alias("price"), F.max_by("price", at).alias("closing"))
    wide = [F.max(F.when(F.col("outcome") == k, F.col(c))).alias(f"{n}{k}") for c, n in (("price", "q"), ("closing", "z")) for k in range(3)]
    triples = each.groupBy("contest", "maker").agg(*wide, F.count("*").alias("n")).where("n = 3").drop("n").withColumn("over", 1 / F.col("q0") + 1 / F.col("q1") + 1 / F.col("q2"))
    names = ["maker", *[f"{n}{k}" for n in "qz" for k in range(3)], "over"]
    return triples.groupBy("contest").agg(F.min_by(F.struct(*names), F.struct("over", "maker")).alias("b")).select("contest", "b.*")


@query(f"""with {CONTESTS}, {FORECASTS}, {MODELS}, {_PRICES}, seen as (select distinct contest from quotes),
v as (select m.contest_id, m.model_id, m.y, b.maker, case when b.maker is not null then null when s.contest is null then 'no_quote' else 'incomplete' end as reason, p0 * q0 - 1 as e0, p1 * q1 - 1 as e1, p2 * q2 - 1 as e2, p0 - 1 / q0 / over as d0, p1 - 1 / q1 / over as d1, p2 - 1 / q2 / over as d2, q0, q1, q2, z0, z1, z2
    from models m left join best b on m.contest_id = b.contest left join seen s on m.contest_id = s.contest),
k as (select *, case when e0 >= e1 and e0 >= e2 then 0 when e1 >= e2 then 1 when e2 is not null then 2 end as pick from v),
b as (select *, case pick when 0 then e0 when 1 then e1 when 2 then e2 end as ev, case pick when 0 then d0 when 1 then d1 when 2 then d2 end as edge, case pick when 0 then q0 when 1 then q1 when 2 then q2 end as taken, case pick when 0 then z0 when 1 then z1 when 2 then z2 end as closing from k)
select contest_id, model_id, case when maker is null then 'NOT_ELIGIBLE' when edge >= 0.03 and ev >= 0.02 then 'BET' else 'PASS' end as status, reason, maker, pick, ev, edge, case when edge >= 0.03 and ev >= 0.02 then case when pick = y then taken - 1 else -1.0 end end as profit, case when edge >= 0.03 and ev >= 0.02 then taken / closing - 1 end as closing_value from b""")
def value_run(spark, sf):
    """JN18: every forecast against the prices of its contest: eligible or why not, the outcome of most value, the paper decision, its settlement and closing-line value."""
    m = models(forecasts(contests(spark, sf))).select("contest_id", "model_id", "y", "p0", "p1", "p2")
    q = quotes(spark, sf).select(F.col("contest").alias("contest_id"), F.lit(True).alias("seen")).distinct()
    rows = m.join(best_triples(spark, sf).withColumnRenamed("contest", "contest_id"), "contest_id", "left").join(q, "contest_id", "left")
    e = [F.col(f"p{k}") * F.col(f"q{k}") - 1 for k in range(3)]
    d = [F.col(f"p{k}") - 1 / F.col(f"q{k}") / F.col("over") for k in range(3)]
    rows = rows.withColumns({"e": F.array(*e), "d": F.array(*d), "q": F.array("q0", "q1", "q2"), "z": F.array("z0", "z1", "z2")})
    pick = F.when((e[0] >= e[1]) & (e[0] >= e[2]), 0).when(e[1] >= e[2], 1).when(e[2].isNotNull(), 2)
    rows = rows.withColumn("pick", pick)
    rows = rows.withColumns({n: F.get(c, F.col("pick")) for n, c in (("ev", "e"), ("edge", "d"), ("taken", "q"), ("closing", "z"))})
    bet = (F.col("edge") >= 0.03) & (F.col("ev") >= 0.02)
    none = F.col("maker").isNull()
    return rows.select(
        "contest_id", "model_id", F.when(none, "NOT_ELIGIBLE").when(bet, "BET").otherwise("PASS").alias("status"), F.when(~none, None).when(F.col("seen").isNull(), "no_quote").otherwise("incomplete").alias("reason"),
        "maker", "pick", "ev", "edge", F.when(bet, F.when(F.col("pick") == F.col("y"), F.col("taken") - 1).otherwise(-1.0)).alias("profit"), F.when(bet, F.col("taken") / F.col("closing") - 1).alias("closing_value"),
    )


_SNAP = f"""{_STAGES_SQL}, form as (select entity_id, available_at, contest_id, case when count(*) over w >= 5 then avg(pts) over w end as form from entity_rows window w as (partition by entity_id order by available_at, contest_id rows between 4 preceding and current row)),
f1 as (select * from form qualify row_number() over (partition by entity_id, available_at order by contest_id desc) = 1),
asks as (select contest_id, side, entity_id, stage, event_ts - to_minutes(minutes) as at from entity_rows, stages),
each_side as (select a.contest_id, a.stage, a.side, f1.form from asks a asof left join f1 on a.entity_id = f1.entity_id and a.at >= f1.available_at),
snap as (select contest_id, stage, max(form) filter (side = 'L') as lf, max(form) filter (side = 'R') as rf from each_side group by 1, 2),
frame as (select s.*, case when lf is null or rf is null then 'UNKNOWN' else 'KNOWN' end as history, b.q0, b.q1, b.q2, b.over from snap s left join best b on s.contest_id = b.contest),
plug as (select contest_id, stage, history, 'prior' as model, cast(0.45 as double) as p0, cast(0.27 as double) as p1, cast(0.28 as double) as p2 from frame
    union all select contest_id, stage, history, 'form', (lf + 1) / (lf + rf + 3), 1 / (lf + rf + 3), (rf + 1) / (lf + rf + 3) from frame
    union all select contest_id, stage, history, 'market', 1 / q0 / over, 1 / q1 / over, 1 / q2 / over from frame
    union all select contest_id, stage, history, 'broken', case when contest_id % 3 = 0 then null else 0.5 end, case when contest_id % 3 = 1 then 0.9 else 0.25 end, 0.25 from frame),
done as (select *, case when p0 is null and p1 is null and p2 is null then 'abstained' when p0 between 0 and 1 and p1 between 0 and 1 and p2 between 0 and 1 and abs(p0 + p1 + p2 - 1) <= 1e-9 then 'predicted' else 'error' end as status from plug)"""


def snapshot_frame(spark, sf):
    """One row for each contest and stage: both sides' form known at the stage, its status, and the prices."""
    rows = entity_rows(contests(spark, sf))
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("minutes")) for s, m in _STAGES])
    asks = rows.select("contest_id", "side", "entity_id", "event_ts", F.explode(stages).alias("s")).select("contest_id", "side", "entity_id", "s.stage", (F.col("event_ts") - F.make_dt_interval(mins=F.col("s.minutes"))).alias("at"))
    state = last_state(running(rows, ["entity_id"], ["available_at", "contest_id"], {"form": (F.avg, "pts", 5, 5)}), ["entity_id"], "available_at", ["contest_id"])
    sides = as_of(asks, state, ["entity_id"], "at", "available_at", ["form"])
    snap = sides.repartition("contest_id").groupBy("contest_id", "stage").agg(F.max(F.when(F.col("side") == "L", F.col("form"))).alias("lf"), F.max(F.when(F.col("side") == "R", F.col("form"))).alias("rf"))
    history = F.when(F.col("lf").isNull() | F.col("rf").isNull(), "UNKNOWN").otherwise("KNOWN")
    return snap.withColumn("history", history).join(best_triples(spark, sf).withColumnRenamed("contest", "contest_id"), "contest_id", "left")


def _form():
    total = F.col("lf") + F.col("rf") + 3
    return (F.col("lf") + 1) / total, 1 / total, (F.col("rf") + 1) / total


PLUGINS = {
    "prior": lambda: (F.lit(0.45), F.lit(0.27), F.lit(0.28)),
    "form": _form,
    "market": lambda: [1 / F.col(f"q{k}") / F.col("over") for k in range(3)],
    "broken": lambda: (F.when(F.col("contest_id") % 3 != 0, 0.5), F.when(F.col("contest_id") % 3 == 1, 0.9).otherwise(0.25), F.lit(0.25)),
}


@query(f"""with {CONTESTS}, {ENTITY}, {_PRICES}, {_SNAP} select contest_id, stage, history, model, status, case when status = 'predicted' then p0 end as p0, case when status = 'predicted' then p1 end as p1, case when status = 'predicted' then p2 end as p2 from done where model <> 'broken'""")
def stage_snapshots(spark, sf):
    """JN19: features, their status and prices at each stage, then every model's forecast from the same frame; a model that cannot predict abstains and nothing stands in for it."""
    plugins = {k: v for k, v in PLUGINS.items() if k != "broken"}
    return guards.predict_all(snapshot_frame(spark, sf), ["contest_id", "stage", "history"], plugins)


@query(f"""with {CONTESTS}, {ENTITY}, {_PRICES}, {_SNAP} select model, status, count(*) as n, avg(case when status = 'predicted' then p0 end) as mean_p0 from done group by 1, 2""")
def plugin_statuses(spark, sf):
    """EXT1: plug-ins on a common frame; vectors that are no shares are errors, nulls abstain."""
    return guards.predict_all(snapshot_frame(spark, sf), ["contest_id", "stage"], PLUGINS).groupBy("model", "status").agg(F.count("*").alias("n"), F.avg("p0").alias("mean_p0"))


@query(f"""with {CONTESTS}, {FORECASTS}, o as (select season as origin, min(event_ts) as start_ts from contests group by 1), w(weight) as (values (0.0), (10.0), (50.0), (200.0)),
t as (select o.origin, f.pool, count(*) as n, count(*) filter (y = 0) as a, count(*) filter (y = 1) as b, count(*) filter (y = 2) as c from o join forecasts f on f.available_at <= o.start_ts group by 1, 2),
g as (select origin, sum(n) as gn, sum(a) as ga, sum(b) as gb, sum(c) as gc from t group by 1)
select strftime(f.season, '%Y-%m-%d') as origin, weight, count(*) as n, avg(-ln(greatest((case y when 0 then a + weight * ga / gn when 1 then b + weight * gb / gn else c + weight * gc / gn end) / (t.n + weight), 1e-15))) as loss
from forecasts f join t on f.season = t.origin and f.pool = t.pool join g on t.origin = g.origin, w group by 1, 2""")
def prior_weights(spark, sf):
    """MET18: loss of shares by pool drawn to the overall ones, for several prior weights at every origin, from what was known there; running sums over origins, no pairs."""
    f = forecasts(contests(spark, sf))
    starts = f.groupBy("season").agg(F.min("event_ts").alias("start_ts"))
    order = F.broadcast(starts.agg(F.sort_array(F.collect_list(F.struct("start_ts", "season"))).alias("all")))  # one row an origin
    first = F.get(F.filter("all", lambda s: s.start_ts >= F.col("available_at")), 0).getField("season")
    hits = [F.sum((F.col("y") == k).cast("long")).alias(f"h{k}") for k in range(3)]
    known = f.join(order).withColumn("season", first).where("season is not null").groupBy("season", "pool").agg(F.count("*").alias("n"), *hits)
    grid = starts.select("season").join(F.broadcast(f.select("pool").distinct()))
    run, whole = Window.partitionBy("pool").orderBy("season").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("season")
    names = ["n", "h0", "h1", "h2"]
    t = grid.join(known, ["season", "pool"], "left").fillna(0, names).select("season", "pool", *[F.sum(c).over(run).alias(c) for c in names])
    t = t.withColumns({f"g{c}": F.sum(c).over(whole) for c in names}).where("n > 0")
    tally = f.groupBy("season", "pool", "y").agg(F.count("*").alias("rows_n"))  # equal rows lose the same, so their losses are not added up one by one
    rows = tally.join(t, ["season", "pool"]).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in (0.0, 10.0, 50.0, 200.0)])))
    share = [(F.col(f"h{k}") + F.col("weight") * F.col(f"gh{k}") / F.col("gn")) / (F.col("n") + F.col("weight")) for k in range(3)]
    loss = -F.log(F.greatest(F.get(F.array(*share), F.col("y")), F.lit(1e-15)))
    return rows.groupBy(F.date_format("season", "yyyy-MM-dd").alias("origin"), "weight").agg(F.sum("rows_n").alias("n"), (F.sum(F.col("rows_n") * loss) / F.sum("rows_n")).alias("loss"))


@query(f"""with {CONTESTS}, r as (select event_ts < timestamp '2024-01-15' as ref, case when contest_id % 13 <> 0 then left_n end as a, case when contest_id % 17 <> 0 then right_n end as b from contests),
l as (select ref, 'a' as feature, a as v from r union all select ref, 'b', b from r)
select feature, (avg(v) filter (not ref) - avg(v) filter (ref)) / stddev_pop(v) filter (ref) as shift, cast(count(*) filter (not ref and v is null) as double) / count(*) filter (not ref) as missing, cast(count(*) filter (ref and v is null) as double) / count(*) filter (ref) as missing_before from l group by 1""")
def feature_shift(spark, sf):
    """DRF4: shift of each feature's mean in standard deviations of the reference, and its missing shares."""
    ref = F.col("event_ts") < F.expr("timestamp '2024-01-15'")
    r = contests(spark, sf).select(ref.alias("ref"), F.when(F.col("contest_id") % 13 != 0, F.col("left_n")).alias("a"), F.when(F.col("contest_id") % 17 != 0, F.col("right_n")).alias("b"))
    l = r.unpivot("ref", ["a", "b"], "feature", "v")  # noqa: E741
    of = lambda f, is_ref: f(F.when(F.col("ref") == is_ref, F.col("v")))
    gone = lambda is_ref: F.sum(((F.col("ref") == is_ref) & F.col("v").isNull()).cast("long")) / F.sum((F.col("ref") == is_ref).cast("long"))
    return l.groupBy("feature").agg(((of(F.avg, False) - of(F.avg, True)) / of(F.stddev_pop, True)).alias("shift"), gone(False).alias("missing"), gone(True).alias("missing_before"))


@query(f"""{_M}, s as (select model_id, event_ts < timestamp '2024-01-15' as ref, p0, p1, p2, {_LOSS} as l from models)
select model_id, avg(p0) filter (not ref) - avg(p0) filter (ref) as d0, avg(p1) filter (not ref) - avg(p1) filter (ref) as d1, avg(p2) filter (not ref) - avg(p2) filter (ref) as d2, avg(l) filter (ref) as loss_before, avg(l) filter (not ref) as loss_now, case when avg(l) filter (not ref) - avg(l) filter (ref) > 0.02 then 'ALARM' else 'OK' end as status from s group by 1""")
def forecast_shift(spark, sf):
    """DRF5: change of each model's mean vector, and the increase of its settled loss with an alarm."""
    s = _scored(spark, sf).withColumn("ref", F.col("event_ts") < F.expr("timestamp '2024-01-15'"))
    of = lambda c, is_ref: F.avg(F.when(F.col("ref") == is_ref, F.col(c)))
    up = of("log_loss", False) - of("log_loss", True)
    return s.groupBy("model_id").agg(
        *[(of(f"p{k}", False) - of(f"p{k}", True)).alias(f"d{k}") for k in range(3)], of("log_loss", True).alias("loss_before"), of("log_loss", False).alias("loss_now"), F.when(up > 0.02, "ALARM").otherwise("OK").alias("status"),
    )


@query(f"""with {CONTESTS}, {FORECASTS}, l as (select pool, pool || ':' || count(*) || ':' || count(*) filter (y = 0) || ':' || count(*) filter (y = 1) || ':' || count(*) filter (y = 2) as line from forecasts group by 1),
d as (select sha256(string_agg(line, ',' order by line)) as digest from l) select run, digest, case run when 1 then 'WRITTEN' else 'UNCHANGED' end as status from d, (values (1), (2)) r(run)""")
def refit_digest(spark, sf):
    """LKG10: a fit made twice from the same rows has one digest of its parameters, and is registered once."""
    f = forecasts(contests(spark, sf))
    out = None
    for k, rows in ((1, f), (2, f.repartition("contest_id"))):
        counts = rows.groupBy("pool").agg(F.concat_ws(":", "pool", F.count("*").cast("string"), *[F.sum((F.col("y") == y).cast("long")).cast("string") for y in range(3)]).alias("line"))
        fit = counts.agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("line"))), 256).alias("digest")).select(F.lit("frequencies").alias("spec"), F.lit(k).alias("run"), "digest")
        out = fit if out is None else out.unionByName(fit)
    first, again = out.where("run = 1"), out.where("run = 2")
    done = tables.ledger(first.limit(0), first, "spec", ["digest"]).unionByName(tables.ledger(first, again, "spec", ["digest"]))
    return done.select("run", "digest", "status")


@query(f"""with {CONTESTS} select contest_id, ntile(2) over w as half, ntile(3) over w as third, cast(date_diff('day', timestamp '2024-01-01', date_trunc('day', event_ts)) // 7 as bigint) as week from contests window w as (partition by pool, season order by event_ts, contest_id)""")
def chronological_blocks(spark, sf):
    """WIN18: halves and thirds of each pool's season in order of time, and weeks of fixed length."""
    w = Window.partitionBy("pool", "season").orderBy("event_ts", "contest_id")
    week = F.floor(F.datediff(F.to_date("event_ts"), F.lit("2024-01-01")) / 7)
    return contests(spark, sf).select("contest_id", F.ntile(2).over(w).alias("half"), F.ntile(3).over(w).alias("third"), week.alias("week"))


@query(f"""with {CONTESTS}, a as (select distinct pool, season from contests where left_n > 3), b as (select distinct pool, season from contests where right_n > 2 and event_ts < timestamp '2024-01-15')
select pool, strftime(season, '%Y-%m-%d') as season from (select * from a except select * from b)""")
def season_differences(spark, sf):
    """SET3: seasons of one table that another lacks."""
    c = contests(spark, sf)
    a = c.where("left_n > 3").select("pool", "season")
    b = c.where("right_n > 2 and event_ts < timestamp '2024-01-15'").select("pool", "season")
    return a.subtract(b).select("pool", F.date_format("season", "yyyy-MM-dd").alias("season"))


@query(f"""{_M}, s as (select *, {_LOSS} as l from models), m(metric) as (values ('accuracy'), ('log_loss'), ('rps'))
select model_id, metric, avg(case metric when 'log_loss' then l when 'rps' then (pow(p0 - cast(y <= 0 as int), 2) + pow(p0 + p1 - cast(y <= 1 as int), 2)) / 2 else cast(case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end = y as int) end) as value from s, m group by 1, 2""")
def named_metrics(spark, sf):
    """EXT3: metrics asked for by name, all in one aggregate; an unknown name is refused."""
    return metrics_by_name(models(forecasts(contests(spark, sf))), ["accuracy", "log_loss", "rps"], ["model_id"])


METRICS = {
    "accuracy": lambda p, y: (F.when((p[0] >= p[1]) & (p[0] >= p[2]), 0).when(p[1] >= p[2], 1).otherwise(2) == y).cast("double"),
    "log_loss": lambda p, y: scores.log_loss(F.array(*p), y),
    "rps": lambda p, y: (F.pow(p[0] - (y <= 0).cast("int"), 2) + F.pow(p[0] + p[1] - (y <= 1).cast("int"), 2)) / 2,
}


def metrics_by_name(rows, names: list[str], by: list[str]):
    """(by, metric, value): the mean of each named metric; raises for a name that is not registered."""
    unknown = sorted(set(names) - set(METRICS))
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known are {sorted(METRICS)}")
    p = [F.col(f"p{k}") for k in range(3)]
    wide = rows.groupBy(*by).agg(*[F.avg(METRICS[n](p, F.col("y"))).alias(n) for n in names])
    return wide.unpivot(by, names, "metric", "value")


@query(f"""with {CONTESTS}, f as (select min(event_ts) as t0 from contests) select pool, count(*) as n, sum(pow(0.5, (epoch(timestamp '2024-02-01') - floor(epoch(event_ts))) / 86400.0 / 30) * left_n) / sum(pow(0.5, (epoch(timestamp '2024-02-01') - floor(epoch(event_ts))) / 86400.0 / 30)) as weighted, avg(left_n) filter (event_ts >= timestamp '2024-02-01' - interval 90 day) as mean_90, avg(left_n) filter (event_ts >= timestamp '2024-02-01' - interval 365 day) as mean_365 from contests group by 1""")
def decayed_means(spark, sf):
    """WIN8: means over 90 and 365 days and by half-life at a decision time."""
    at = F.expr("timestamp '2024-02-01'")
    age = (F.unix_seconds(at) - F.unix_seconds("event_ts")) / F.lit(86400.0)
    w = F.pow(F.lit(0.5), age / 30)
    last = lambda days: F.avg(F.when(F.col("event_ts") >= at - F.make_dt_interval(days=F.lit(days)), F.col("left_n")))
    return contests(spark, sf).groupBy("pool").agg(F.count("*").alias("n"), (F.sum(w * F.col("left_n")) / F.sum(w)).alias("weighted"), last(90).alias("mean_90"), last(365).alias("mean_365"))


@query(f"""with {CONTESTS}, {FORECASTS}, h as (select contest_id, cast(p0 >= p1 and p0 >= p2 and y = 0 or p1 > p0 and p1 >= p2 and y = 1 or p2 > p0 and p2 > p1 and y = 2 as bigint) as hit, pool from forecasts),
claim as (select pool, count(*) as n, sum(hit) + case when pool = 'click' then 1 else 0 end as hits from h group by 1)
select c.pool, cast(c.n as bigint) as claimed_n, cast(c.hits as bigint) as claimed_hits, count(*) as n, cast(sum(hit) as bigint) as hits, case when c.n = count(*) and c.hits = sum(hit) then 'CONFIRMED' else 'REFUTED' end as status from claim c join h on c.pool = h.pool group by c.pool, c.n, c.hits""")
def recomputed_claims(spark, sf):
    """AGG28: published hit tables recomputed from the rows; a claim that differs is refuted."""
    f = forecasts(contests(spark, sf))
    pick = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    again = f.groupBy("pool").agg(F.count("*").alias("n"), F.sum((pick == F.col("y")).cast("long")).alias("hits"))
    claims = again.select("pool", F.col("n").alias("claimed_n"), (F.col("hits") + (F.col("pool") == "click").cast("long")).alias("claimed_hits"))
    status = F.when((F.col("n") == F.col("claimed_n")) & (F.col("hits") == F.col("claimed_hits")), "CONFIRMED").otherwise("REFUTED")
    return claims.join(again, "pool").select("pool", "claimed_n", "claimed_hits", "n", "hits", status.alias("status"))

