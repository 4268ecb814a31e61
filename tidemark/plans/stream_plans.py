"""Streaming jobs over the events table. The query runs the stream once over what is there and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import Registry
from tidemark.sources.tables import read_table
from tidemark.storage import shared_path
from tidemark.streaming import jobs, stateful

query = Registry()


def stream(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """The events as a stream of files; zoneless times made instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    return files.withColumn("ts", F.col("ts").cast("timestamp")).select(*columns)


def run_once(df: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is available into Parquet in the shared folder and read that."""
    spark = df.sparkSession
    out, state = shared_path(spark, f"{name}-out"), shared_path(spark, f"{name}-state")
    q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("""select event_id, user_id, event_type from events""")
def stream_ingest(spark, sf):
    """STR1: repeats dropped by a content key across polls (the stream carries each event twice)."""
    s = stream(spark, sf, ["event_id", "user_id", "event_type", "ts"])
    return run_once(jobs.ingest(s.unionByName(s), "ts", ["event_id", "user_id", "event_type"], "60 days").select("event_id", "user_id", "event_type"), "ingest")


@query("""with c as (select user_id, max(greatest(0, cast(floor(value) as bigint) % 7)) as top from events group by 1) select user_id, cast(top as bigint) as raised from c where top > 0""")
def stream_derived(spark, sf):
    """STR2: units by which a polled count rose, from keyed state."""
    s = stream(spark, sf, ["user_id", "ts", "value"]).select("user_id", "ts", (F.floor("value").cast("long") % 7).alias("count"))
    return run_once(jobs.derived_events(s, "user_id", "ts", "count"), "derived").groupBy("user_id").agg(F.sum("n").alias("raised"))


@query("""select event_type, cast(count(*) as bigint) as n, count(distinct time_bucket(interval 10 minute, ts)) as windows, round(sum(value), 4) as total from events where time_bucket(interval 10 minute, ts) + interval 10 minute <= (select max(ts) - interval 2 hour from events) group by 1""")
def stream_windows(spark, sf):
    """STR9: tumbling windows by key, closed by the watermark of an hour; those that end two hours before the last event have surely closed."""
    last = read_table(spark, sf, "events").agg((F.max("ts") - F.expr("interval 130 minutes")).alias("t")).first()[0]
    s = stream(spark, sf, ["event_type", "ts", "value"])
    w = run_once(jobs.quote_windows(s, "ts", ["event_type"], "value"), "windows").where(F.col("start") <= F.lit(last))
    return w.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("windows"), F.round(F.sum(F.col("mean") * F.col("n")), 4).alias("total"))


@query("""with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 6 hour then 1 else 0 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, count(*) as sessions, max(n) as longest from (select user_id, k, count(*) as n from s group by 1, 2) group by 1""")
def session_table(spark, sf):
    """STR8 (batch form): sessions with a gap limit."""
    e = read_table(spark, sf, "events")
    return jobs.sessions(e, "ts", ["user_id"], "6 hours").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("""select event_id, case when ts + interval 3 hour <= date_trunc('day', ts) + interval 20 hour then 'VISIBLE' else 'LATE' end as status from events""")
def stream_freeze(spark, sf):
    """STR7: facts against their day's cutoff; late ones are kept and marked."""
    s = stream(spark, sf, ["event_id", "ts"]).select("event_id", (F.col("ts") + F.expr("interval 3 hours")).alias("known"), (F.date_trunc("day", "ts") + F.expr("interval 20 hours")).alias("cutoff"))
    return run_once(jobs.freeze(s, "known", "cutoff").select("event_id", "status"), "freeze")


@query("""select e.event_id, q.event_id as quote_id from events e join events q on e.user_id = q.user_id and q.event_type = 'view' and e.event_type = 'purchase' and q.ts <= e.ts and q.ts >= e.ts - interval 1 hour""")
def stream_join(spark, sf):
    """STR11: stream-stream join within an interval, state bounded by watermarks."""
    e = stream(spark, sf, ["event_id", "user_id", "event_type", "ts"])
    q = e.where("event_type = 'view'").select(F.col("event_id").alias("quote_id"), "user_id", F.col("ts").alias("quote_ts"))
    return run_once(jobs.interval_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), q, "user_id", "ts", "quote_ts", "1 hour", "60 days").select("event_id", "quote_id"), "join")


STAGES = {"t-24h": 1440, "t-90m": 90, "t-30m": 30, "start": 5}


@query(f"""with f as (select user_id * 1000 + dayofyear(d) as key, epoch_ms(ts) as at, value, epoch_ms(cast(d as timestamp) + interval 20 hour) as ev from (select *, unnest([cast(ts as date), cast(ts as date) + 1]) as d from events)),
wm as (select max(epoch_ms(ts)) - 3600000 as wm from events), k as (select key, max(ev) as ev from f group by 1), st as (select * from (values {", ".join(f"('{s}', {m})" for s, m in STAGES.items())}) v(stage, minutes)),
c as (select key, ev, stage, ev - minutes * 60000 as cutoff, wm from k, st, wm where ev - minutes * 60000 <= wm)
select c.key, c.stage, make_timestamp(c.cutoff * 1000) as cutoff, case when count(f.at) = 0 then 'EMPTY' else 'FROZEN' end as status, last(f.value order by f.at, f.value) as value, cast(count(f.at) as bigint) as facts, any_value(c.wm >= c.ev) as missed, cast(any_value((c.wm - c.cutoff) // 60000) as bigint) as late_minutes
from c left join f on f.key = c.key and f.at <= c.cutoff group by c.key, c.stage, c.cutoff""")
def stream_stages(spark, sf):
    """STR6: stages frozen by event-time timers when their cutoff passes, with or without a fact; late runs tell their minutes."""
    stateful.state_store(spark)
    days = F.explode(F.array(F.to_date("ts"), F.date_add(F.to_date("ts"), 1)))
    s = stream(spark, sf, ["user_id", "ts", "value"]).select("user_id", "ts", "value", days.alias("day"))
    s = s.select((F.col("user_id") * 1000 + F.dayofyear("day")).alias("key"), "ts", (F.col("day").cast("timestamp") + F.expr("interval 20 hours")).alias("event_at"), "value")
    frozen = run_once(stateful.freeze_stages(s, "key", "ts", "event_at", "value", STAGES), "stages")
    return frozen.select("key", "stage", F.col("cutoff").cast("timestamp_ntz").alias("cutoff"), "status", "value", "facts", "missed", "late_minutes")


@query("""with p as (select event_id, user_id as key, ts as moment, ts - interval 1 minute * (event_id % 140) as start_at, case when event_id % 7 = 0 then 'FINISHED' else 'IN_PLAY' end as status, cast(floor(value) as bigint) % 4 as total,
    case when event_id % 3 = 0 then event_id % 90 end as reported, max(case when event_id % 5 = 0 then event_id % 50 end) over (partition by user_id order by ts, cast(floor(value) as bigint) % 4, event_id rows unbounded preceding) as newest from events),
m as (select *, event_id % 140 as gone, case when event_id % 140 <= 45 then event_id % 140 when event_id % 140 <= 60 then 45 else least(event_id % 140 - 15, 120) end as clock from p),
s as (select *, case when reported is not null then reported when status <> 'IN_PLAY' then null when newest > clock then newest else clock end as minute, case when reported is not null then 'reported' when status <> 'IN_PLAY' then null when newest > clock then 'last_event' else 'clock' end as minute_source from m),
h as (select *, sha256('["' || status || '", ' || total || ', ' || coalesce(cast(minute // 5 as varchar), 'null') || ']') as state_hash from s),
l as (select *, lag(state_hash) over w as prev, row_number() over w as polls from h window w as (partition by key order by moment, total, event_id))
select key, moment as "at", status, total, cast(minute as int) as minute, minute_source, state_hash, polls, status = 'IN_PLAY' and minute is not null and not coalesce(minute_source = 'clock' and minute > 100, false) as forecastable from l where prev is null or prev <> state_hash""")
def stream_states(spark, sf):
    """STR3: keyed states told on change of their five-minute bucket's hash, with the minute's source and stale clocks marked."""
    stateful.state_store(spark)
    i = F.col("event_id")
    s = stream(spark, sf, ["event_id", "user_id", "ts", "value"]).select(
        F.col("user_id").alias("key"), F.col("ts").alias("at"), (F.col("ts") - F.make_dt_interval(mins=i % 140)).alias("start_at"), F.when(i % 7 == 0, "FINISHED").otherwise("IN_PLAY").alias("status"),
        (F.floor("value").cast("long") % 4).alias("total"), F.when(i % 3 == 0, i % 90).cast("int").alias("reported"), F.when(i % 5 == 0, i % 50).cast("int").alias("event_minute"),
    )
    return run_once(stateful.changed_states(s, "key"), "states").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""with q as (select event_id, user_id % 5 as contest, event_type as maker, event_id % 3 as outcome, 1.05 + (event_id % 400) / cast(100 as double) as price, ts - interval 1 minute * (event_id % 5) as stated, ts as seen from events),
n as (select r.event_id, r.contest, r.maker, r.seen, o.outcome, last(o.price order by o.stated, o.seen) as price, max(o.stated) as stated from q r join q o on o.contest = r.contest and o.maker = r.maker and o.seen <= r.seen group by all),
t as (select event_id, contest, maker, seen as moment, max(price) filter (outcome = 0) as a, max(price) filter (outcome = 1) as b, max(price) filter (outcome = 2) as c, min(stated) as oldest from n group by 1, 2, 3, 4
    having count(*) = 3 and max(epoch_ms(stated)) - min(epoch_ms(stated)) <= 3 * 86400000 and epoch_ms(any_value(seen)) - min(epoch_ms(stated)) <= 5 * 86400000),
l as (select contest, maker, time_bucket(interval 1 day, moment) as start, arg_max(1 / a / (1 / a + 1 / b + 1 / c), moment) as p_a, arg_max(1 / b / (1 / a + 1 / b + 1 / c), moment) as p_b, arg_max(1 / c / (1 / a + 1 / b + 1 / c), moment) as p_c from t group by 1, 2, 3)
select contest, start, count(*) as makers, round(avg(p_a), 9) as p_a, round(avg(p_b), 9) as p_b, round(avg(p_c), 9) as p_c, round((stddev_pop(p_a) + stddev_pop(p_b) + stddev_pop(p_c)) / 3, 9) as dispersion from l
where epoch_ms(start) + 86400000 <= (select max(epoch_ms(ts)) - 3600000 from events) group by 1, 2 having count(*) >= 2""")
def stream_consensus(spark, sf):
    """STR4: newest price by maker and outcome in state, complete triples within both bounds, then consensus by window behind it."""
    stateful.state_store(spark)
    i = F.col("event_id")
    s = stream(spark, sf, ["event_id", "user_id", "event_type", "ts"]).select(
        (F.col("user_id") % 5).alias("contest"), F.col("event_type").alias("maker"), (i % 3).cast("int").alias("outcome"), (F.lit(1.05) + (i % 400) / F.lit(100.0)).alias("price"),
        (F.col("ts") - F.make_dt_interval(mins=i % 5)).alias("stated_at"), F.col("ts").alias("seen_at"),
    )
    triples = stateful.quote_triples(s, spread_minutes=3 * 1440, stale_hours=120)
    out = run_once(stateful.consensus_windows(triples, "1 day"), "consensus")
    return out.select("contest", F.col("start").cast("timestamp_ntz").alias("start"), "makers", *[F.round(c, 9).alias(c) for c in ("p_a", "p_b", "p_c", "dispersion")])
