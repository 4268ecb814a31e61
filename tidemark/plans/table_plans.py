"""Cleaning, rules, resolution, merging and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import cleaning, tables
from tidemark.plans.registry import Registry
from tidemark.sources.tables import CONTESTS, ENTITY, FORECASTS, MODELS, QUOTES, contests, entity_rows, forecasts, models, outcome, quotes, read_table

query = Registry()

#: Order rows written as text with every 13th date and count broken, and their twin in SQL.
RAW = """raw as (
    select o_orderkey as id, case when o_orderkey % 13 = 0 then 'n/a' when o_orderkey % 2 = 0 then strftime(o_orderdate, '%d/%m/%Y') else strftime(o_orderdate, '%d/%m/%y') end as day_text,
        case when o_orderkey % 17 = 0 then '' when o_orderkey % 19 = 0 then '1.5' when o_orderkey % 23 = 0 then '-2' when o_orderkey % 29 = 0 then 'x' else cast(o_orderkey % 7 as varchar) end as count_text,
        case when o_orderkey % 31 = 0 then null else cast(o_custkey as varchar) end as member
    from orders)"""
_DAY = "case when length(trim(day_text)) = 10 then cast(try_strptime(trim(day_text), '%d/%m/%Y') as date) when length(trim(day_text)) = 8 then cast(try_strptime(trim(day_text), '%d/%m/%y') as date) end"


def raw(spark, sf) -> DataFrame:
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.when(k % 13 == 0, "n/a").when(k % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yy"))
    count = F.when(k % 17 == 0, "").when(k % 19 == 0, "1.5").when(k % 23 == 0, "-2").when(k % 29 == 0, "x").otherwise((k % 7).cast("string"))
    return o.select(k.alias("id"), day.alias("day_text"), count.alias("count_text"), F.when(k % 31 != 0, F.col("o_custkey").cast("string")).alias("member"))


@query(f"with {RAW} select id, day_text, strftime({_DAY}, '%Y-%m-%d') as day from raw")
def parse_days(spark, sf):
    """CLN2: dates in two formats."""
    return raw(spark, sf).select("id", "day_text", cleaning.parse_day(F.col("day_text")).cast("string").alias("day"))


_NUM = "try_cast(trim(count_text) as double)"
_NUM_REASON = f"case when trim(count_text) = '' then null when {_NUM} is null then 'not_a_number' when {_NUM} < 0 or floor({_NUM}) <> {_NUM} then 'not_a_count' end"


@query(f"with {RAW} select id, case when {_NUM_REASON} is null then cast({_NUM} as bigint) end as n, {_NUM_REASON} as reason from raw")
def parse_counts(spark, sf):
    """CLN5: counts from text, blank is null, fractions and words are refused."""
    n, reason = cleaning.whole_number(F.col("count_text"))
    return raw(spark, sf).select("id", n.alias("n"), reason.alias("reason"))


_REJECT = f"case when member is null then 'missing_member' when {_DAY} is null then 'invalid_date' when {_NUM_REASON} is not null then 'invalid_count' when trim(count_text) = '' then 'missing_count' end"


@query(f"with {RAW} select coalesce({_REJECT}, 'accepted') as reason, count(*) as n, min(id) as first_id from raw group by 1")
def reject_reasons(spark, sf):
    """CLN1 and AGG2: each row is accepted or has its first reason; counts by reason."""
    n, bad = cleaning.whole_number(F.col("count_text"))
    reason = tables.first_reason({"missing_member": F.col("member").isNull(), "invalid_date": cleaning.parse_day(F.col("day_text")).isNull(), "invalid_count": bad.isNotNull(), "missing_count": n.isNull()})
    return raw(spark, sf).groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"""with {QUOTES}, l as (select contest, maker, outcome, arg_max(price, seq) as price from quotes where price > 1 group by 1, 2, 3)
select contest, maker, max(case when outcome = 0 then price end) as p0, max(case when outcome = 1 then price end) as p1, max(case when outcome = 2 then price end) as p2 from l group by 1, 2 having count(*) = 3""")
def wide_triples(spark, sf):
    """CLN7 and CLN9: long prices to complete triples; incomplete ones go."""
    last = quotes(spark, sf).where("price > 1").groupBy("contest", "maker", "outcome").agg(F.max_by("price", "seq").alias("price"))
    return last.groupBy("contest", "maker").pivot("outcome", [0, 1, 2]).agg(F.first("price")).toDF("contest", "maker", "p0", "p1", "p2").dropna()


@query(f"with {CONTESTS}, {ENTITY} select contest_id, side, entity_id, opp_id, own_n, opp_n, pts from entity_rows")
def both_sides(spark, sf):
    """CLN8: each contest as both entities see it."""
    return entity_rows(contests(spark, sf)).select("contest_id", "side", "entity_id", "opp_id", "own_n", "opp_n", "pts")


@query(f"""with {CONTESTS} select contest_id, case when left_n > right_n then 0 when left_n = right_n then 1 else 2 end as y, left_n + right_n > 2.5 as over_line, left_n > 0 and right_n > 0 as both_scored,
    concat(isoyear(event_ts), '-W', lpad(cast(week(event_ts) as varchar), 2, '0')) as block, concat_ws('|', pool, strftime(event_ts, '%Y%m%d'), left_id, right_id) as contest_key,
    case when event_ts = date_trunc('day', event_ts) then false else true end as time_known from contests""")
def contest_labels(spark, sf):
    """CLN4, CLN6, CLN10, CLN13, CLN16: outcome, labels, ISO week block, key, known time of day."""
    c = contests(spark, sf)
    week = F.concat(F.expr("extract(yearofweek from event_ts)"), F.lit("-W"), F.lpad(F.weekofyear("event_ts").cast("string"), 2, "0"))
    key = F.concat_ws("|", "pool", F.date_format("event_ts", "yyyyMMdd"), F.col("left_id").cast("string"), F.col("right_id").cast("string"))
    return c.select("contest_id", outcome().alias("y"), (F.col("left_n") + F.col("right_n") > 2.5).alias("over_line"), ((F.col("left_n") > 0) & (F.col("right_n") > 0)).alias("both_scored"), week.alias("block"), key.alias("contest_key"), (F.col("event_ts") != F.date_trunc("day", "event_ts")).alias("time_known"))


@query(f"""with {CONTESTS} select cast(('0x' || substr(sha256('cohort:' || contest_id), 1, 8)) as bigint) % 10000 // 1000 as cohort, count(*) as n, min(contest_id) as first_id from contests group by 1""")
def cohorts(spark, sf):
    """CLN17: salted hash buckets for assignment to cohorts."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit("cohort:"), F.col("contest_id").cast("string")), 256), 1, 8), 16, 10).cast("long") % 10000
    return contests(spark, sf).groupBy(F.floor(bucket / 1000).alias("cohort")).agg(F.count("*").alias("n"), F.min("contest_id").alias("first_id"))


@query("""select o_orderkey, case o_orderstatus when 'F' then 'FINISHED' when 'O' then 'SCHEDULED' end as status, case when o_orderstatus not in ('F', 'O') then o_orderstatus end as unknown_code from orders""")
def code_status(spark, sf):
    """CLN12: codes by a map; a code that the map lacks is named, not guessed."""
    known = F.create_map(F.lit("F"), F.lit("FINISHED"), F.lit("O"), F.lit("SCHEDULED"))
    status = F.try_element_at(known, F.col("o_orderstatus"))
    return read_table(spark, sf, "orders").select("o_orderkey", status.alias("status"), F.when(status.isNull(), F.col("o_orderstatus")).alias("unknown_code"))


@query(f"""with {CONTESTS}, x as (select contest_id, (epoch_us(available_at) - epoch_us(event_ts)) // 60000000 as m, contest_id % 200 as early from contests)
select contest_id, case when early >= 180 then 't-24h' when early >= 60 then 't-90m' when early >= 15 then 't-30m' else 'kickoff' end as stage, case when early < 5 then 'MISSED' when early > 100 then 'DUE' else 'OPEN' end as state from x""")
def stage_labels(spark, sf):
    """CLN15: stage by minutes to the event, and whether it is due or missed."""
    early = F.col("contest_id") % 200
    stage = F.when(early >= 180, "t-24h").when(early >= 60, "t-90m").when(early >= 15, "t-30m").otherwise("kickoff")
    return contests(spark, sf).select("contest_id", stage.alias("stage"), F.when(early < 5, "MISSED").when(early > 100, "DUE").otherwise("OPEN").alias("state"))


@query("""with d as (select o_orderkey, o_custkey % 5 as pool, year(o_orderdate) as season, cast(o_orderdate as date) as day from orders)
select o_orderkey, day = max(day) over (partition by pool, season) as last_day, cast(month(day) in (7, 8) as boolean) as break_month, season || '/' || lpad(cast((season + 1) % 100 as varchar), 2, '0') as season_label from d""")
def season_labels(spark, sf):
    """CLN19 and CLN20: last day of a pool's season, month window, season label."""
    d = read_table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("pool"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"))
    last = F.max("day").over(Window.partitionBy("pool", "season"))
    return d.select("o_orderkey", (F.col("day") == last).alias("last_day"), F.month("day").isin(7, 8).alias("break_month"), F.concat(F.col("season").cast("string"), F.lit("/"), F.lpad(((F.col("season") + 1) % 100).cast("string"), 2, "0")).alias("season_label"))


@query(f"""with {CONTESTS}, {FORECASTS}, v as (select contest_id, unnest([case when contest_id % 97 <> 0 then null else 'id' end, case when p0 + p1 + p2 between 0.999999 and 1.000001 then null else 'sum' end,
    case when p0 < 0.7 then null else 'range' end, case when cutoff < event_ts then null else 'clock' end]) as rule from forecasts) select contest_id, rule from v where rule is not null""")
def constraint_violations(spark, sf):
    """V01 and V02: a table of rules that rows break."""
    rules = {"id": F.col("contest_id") % 97 != 0, "sum": (F.col("p0") + F.col("p1") + F.col("p2")).between(0.999999, 1.000001), "range": F.col("p0") < 0.7, "clock": F.col("cutoff") < F.col("event_ts")}
    return tables.violations(forecasts(contests(spark, sf)), "contest_id", rules)


@query("""select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || '}') as content_hash, c_custkey % 7 = 0 as tampered from customer""")
def content_hashes(spark, sf):
    """V03: content hash of a row, and the check of a stored hash against rows of which some were changed since."""
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    stored = c.withColumn("content_hash", tables.row_hash(["c_custkey", "c_nationkey"]))
    later = stored.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")))
    return later.select("c_custkey", "content_hash", (tables.row_hash(["c_custkey", "c_nationkey"]) != F.col("content_hash")).alias("tampered"))


_ALIASES = """aliases as (select 'feed' || (n_nationkey % 2) as source, upper(n_name) || '.' as raw_name, n_nationkey as target, date '1990-01-01' as valid_from, case when n_nationkey % 3 = 0 then date '1997-12-31' end as valid_to, 0.9 as confidence from nation
    union all select 'feed' || (n_nationkey % 2), n_name, 100 + n_nationkey, date '1998-01-01', null, 0.8 from nation where n_nationkey % 3 = 0
    union all select 'feed' || (n_nationkey % 2), n_name, 200 + n_nationkey, date '1996-01-01', date '1999-12-31', 0.5 from nation where n_nationkey % 5 = 0)"""
_NORM = "trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def aliases(spark, sf) -> DataFrame:
    n, k = read_table(spark, sf, "nation"), F.col("n_nationkey")
    source, day = F.concat(F.lit("feed"), (k % 2).cast("string")).alias("source"), lambda s: F.lit(s).cast("date")
    rows = lambda d, name, add, a, b, w: d.select(source, name.alias("raw_name"), (k + add).alias("target"), a.alias("valid_from"), b.cast("date").alias("valid_to"), F.lit(w).alias("confidence"))
    out = rows(n, F.concat(F.upper("n_name"), F.lit(".")), 0, day("1990-01-01"), F.when(k % 3 == 0, F.lit("1997-12-31")), 0.9)
    out = out.unionByName(rows(n.where(k % 3 == 0), F.col("n_name"), 100, day("1998-01-01"), F.lit(None), 0.8))
    return out.unionByName(rows(n.where(k % 5 == 0), F.col("n_name"), 200, day("1996-01-01"), F.lit("1999-12-31"), 0.5))


@query(f"""with {_ALIASES}, r as (select o_orderkey, 'feed' || (o_orderkey % 2) as source, n_name as name, cast(o_orderdate as date) as day from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
select o_orderkey, target from r left join aliases a on r.source = a.source and {_NORM.format(c="r.name")} = {_NORM.format(c="a.raw_name")} and day between valid_from and coalesce(valid_to, date '9999-12-31')
qualify row_number() over (partition by o_orderkey order by confidence desc nulls last, target) = 1""")
def resolve_aliases(spark, sf):
    """RES1 and RES2: names by the alias that is valid on the day; what has none stays with a null target."""
    o = read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read_table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = o.select("o_orderkey", F.concat(F.lit("feed"), (F.col("o_orderkey") % 2).cast("string")).alias("source"), F.col("n_name").alias("name"), F.to_date("o_orderdate").alias("day"))
    return cleaning.resolve(r, aliases(spark, sf), "name", "source", "day").select("o_orderkey", "target")


@query(f"""with {_ALIASES}, a as (select source, {_NORM.format(c="raw_name")} as norm, target, valid_from, coalesce(valid_to, date '9999-12-31') as e from aliases),
n as (select *, row_number() over () as rid from a)
select x.source, x.norm, x.target, max((y.e, y.target))[2] as other from n x join n y on x.source = y.source and x.norm = y.norm and x.target <> y.target and (y.valid_from, y.target) < (x.valid_from, x.target) and y.e >= x.valid_from group by x.rid, 1, 2, 3""")
def alias_overlaps(spark, sf):
    """RES7: intervals of one name that overlap with different targets."""
    return cleaning.overlapping_aliases(aliases(spark, sf))


@query("""with n as (select s_suppkey, 'Supplier ' || (s_suppkey // 10) as name, s_nationkey as block from supplier)
select a.s_suppkey as a, b.s_suppkey as b from n a join n b on a.block = b.block and a.s_suppkey < b.s_suppkey and levenshtein(a.name, b.name) <= 1 and substr(a.name, 1, 10) = substr(b.name, 1, 10)
where not exists (select 1 from nation where n_nationkey = a.block and n_nationkey % 4 = 0)""")
def duplicate_entities(spark, sf):
    """RES5: names alike within a block, less pairs of excluded blocks; names meet by what is left of them without one letter."""
    n = read_table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Supplier "), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("name"), F.col("s_nationkey").alias("block"))
    alike = cleaning.names_alike(n.select("block", "name").distinct(), "block", "name").where(F.substring("name", 1, 10) == F.substring("other", 1, 10))
    left = n.join(alike, ["block", "name"])
    pairs = left.join(n.select("block", F.col("name").alias("other"), F.col("s_suppkey").alias("b")), ["block", "other"]).where(F.col("s_suppkey") < F.col("b"))
    met = read_table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("block"))
    return pairs.join(met, "block", "left_anti").select(F.col("s_suppkey").alias("a"), "b")


@query("""select c_custkey, coalesce(m.to_id, c_nationkey) as nation from customer left join (select n_nationkey as from_id, n_nationkey - 1 as to_id from nation where n_nationkey % 6 = 5) m on c_nationkey = from_id""")
def remap_ids(spark, sf):
    """RES6: ids through an approved merge table."""
    m = read_table(spark, sf, "nation").where("n_nationkey % 6 = 5").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") - 1).alias("to_id"))
    return read_table(spark, sf, "customer").join(F.broadcast(m), "c_nationkey", "left").select("c_custkey", F.coalesce("to_id", "c_nationkey").alias("nation"))


@query("""with x as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1), y as (select l_partkey from lineitem group by 1 having count(distinct l_suppkey) > 5)
select 'duplicate_key' as rule, count(*) as n from x union all select 'part_of_many', count(*) from y union all select 'same_day_pair', count(*) from (select o_custkey, cast(o_orderdate as date) as d from orders group by 1, 2 having count(*) > 1)""")
def collisions(spark, sf):
    """RES8: identity collisions as one table of rule counts."""
    l, o = read_table(spark, sf, "lineitem"), read_table(spark, sf, "orders")  # noqa: E741
    rule = lambda name, d: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    out = rule("duplicate_key", l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"))
    out = out.unionByName(rule("part_of_many", l.groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("k")).where("k > 5")))
    return out.unionByName(rule("same_day_pair", o.groupBy("o_custkey", F.to_date("o_orderdate")).count().where("count > 1")))


_OLD = "old_t as (select o_orderkey as k, o_custkey as v, o_orderstatus as s from orders where o_orderkey % 10 <> 0), new_t as (select o_orderkey as k, case when o_orderkey % 7 = 0 then o_custkey + 1 else o_custkey end as v, o_orderstatus as s from orders where o_orderkey % 9 <> 0)"


def _versions(spark, sf):
    o = read_table(spark, sf, "orders")
    old = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.col("o_orderstatus").alias("s"))
    new = o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("v"), F.col("o_orderstatus").alias("s"))
    return old, new


@query(f"""with {_OLD} select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when a.v <> b.v or a.s <> b.s then 'changed' else 'unchanged' end as change from old_t a full join new_t b on a.k = b.k""")
def snapshot_diff(spark, sf):
    """JN10: added, removed, changed and unchanged keys between two snapshots."""
    return tables.diff(*_versions(spark, sf), ["k"])


@query(f"""with {_OLD}, a as (select k, 'old' as src, v from old_t) select k, src, v from a union all select k, 'new', v from new_t where k not in (select k from old_t)""")
def precedence_merge(spark, sf):
    """JN8, JN15, SET1: primary rows, others only where the key is missing."""
    old, new = _versions(spark, sf)
    mark = lambda d, s: d.select("k", F.lit(s).alias("src"), "v")
    return tables.prefer(mark(old, "old"), mark(new, "new"), ["k"])


@query(f"""with {_OLD} select coalesce(a.k, b.k) as k, coalesce(b.v, a.v) as v, case when a.k is null then 'secondary' when b.k is null then 'primary' else 'both' end as origin from old_t a full join new_t b on a.k = b.k""")
def overlay(spark, sf):
    """JN9 and JN17: enrich or add, with the origin of each row."""
    old, new = _versions(spark, sf)
    out = old.select("k", F.col("v").alias("a"), F.lit(1).alias("in_a")).join(new.select("k", F.col("v").alias("b"), F.lit(1).alias("in_b")), "k", "full_outer")
    origin = F.when(F.col("in_a").isNull(), "secondary").when(F.col("in_b").isNull(), "primary").otherwise("both")
    return out.select("k", F.coalesce("b", "a").alias("v"), origin.alias("origin"))


@query(f"""with {_OLD} select b.k, case when a.k is null then 'WRITTEN' when a.v = b.v then 'UNCHANGED' else 'CONFLICT' end as status from new_t b left join old_t a on a.k = b.k""")
def ledger_append(spark, sf):
    """SNK4 and LKG9: an immutable ledger; other content under a known key is a conflict, never an overwrite."""
    old, new = _versions(spark, sf)
    return tables.ledger(old, new, "k", ["v"]).select("k", "status")


@query(f"""with {_OLD} select k, v from new_t where k not in (select k from old_t)""")
def append_once(spark, sf):
    """SNK3: rows whose key the sink does not hold yet."""
    old, new = _versions(spark, sf)
    return new.join(old, "k", "left_anti").select("k", "v")


@query(f"""with {RAW}, bad as (select id, {_REJECT} as error from raw where {_REJECT} is not null) select r.id, b.error, cast(length(r.count_text) as bigint) as width from raw r join bad b using (id) where b.error in ('invalid_count', 'missing_count')""")
def dead_letters(spark, sf):
    """SNK5: failed rows with their error, and a replay of only those keys."""
    r = raw(spark, sf)
    n, bad = cleaning.whole_number(F.col("count_text"))
    reason = tables.first_reason({"missing_member": F.col("member").isNull(), "invalid_date": cleaning.parse_day(F.col("day_text")).isNull(), "invalid_count": bad.isNotNull(), "missing_count": n.isNull()})
    letters = r.select("id", reason.alias("error")).where("error in ('invalid_count', 'missing_count')")
    return r.join(letters, "id").select("id", "error", F.length("count_text").cast("long").alias("width"))


@query(f"""with {CONTESTS}, {FORECASTS}, {MODELS}, n as (select contest_id from models group by 1 having count(distinct model_id) = (select count(distinct model_id) from models)) select model_id, count(*) as rows_n, sum(contest_id) as ids from models semi join n using (contest_id) group by 1""")
def common_contests(spark, sf):
    """JN11: only contests that every model scored."""
    return tables.common_set(models(forecasts(contests(spark, sf))), "contest_id", "model_id").groupBy("model_id").agg(F.count("*").alias("rows_n"), F.sum("contest_id").alias("ids"))


@query(f"""with {CONTESTS}, {FORECASTS}, {MODELS} select a.contest_id, a.p0 - b.p0 as d0, a.p2 - b.p2 as d2, a.y from models a join models b using (contest_id) where a.model_id = 1 and b.model_id = 3""")
def candidate_pairs(spark, sf):
    """JN12: candidate against reference on the same contest."""
    m = models(forecasts(contests(spark, sf)))
    b = m.where("model_id = 3").select("contest_id", F.col("p0").alias("q0"), F.col("p2").alias("q2"))
    return m.where("model_id = 1").join(b, "contest_id").select("contest_id", (F.col("p0") - F.col("q0")).alias("d0"), (F.col("p2") - F.col("q2")).alias("d2"), "y")


@query(f"""with {CONTESTS}, {FORECASTS}, {QUOTES}, l as (select contest, count(distinct outcome) as n from quotes group by 1), r as (select f.contest_id, case when y is null then 'no_result' when l.n is null then 'no_price' when l.n < 3 then 'incomplete_price' else 'scored' end as reason from forecasts f left join l on l.contest = f.contest_id)
select reason, count(*) as n from r group by 1""")
def drop_reasons(spark, sf):
    """JN13: forecast, result and price, with every drop counted by reason."""
    f = forecasts(contests(spark, sf))
    l = quotes(spark, sf).groupBy("contest").agg(F.countDistinct("outcome").alias("n"))  # noqa: E741
    reason = F.when(F.col("y").isNull(), "no_result").when(F.col("n").isNull(), "no_price").when(F.col("n") < 3, "incomplete_price").otherwise("scored")
    return f.join(l, f["contest_id"] == l["contest"], "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"""with {_OLD}, x as (select k, 'v' as c, cast(v as double) as a from old_t), y as (select k, 'v' as c, cast(v as double) as b from new_t)
select coalesce(x.k, y.k) as k, a as "left", b as "right", case when x.k is null then 'added' when y.k is null then 'removed' else 'differs' end as status from x full join y on x.k = y.k where x.k is null or y.k is null or abs(a - b) > 0.5""")
def tolerant_compare(spark, sf):
    """V06: cell by cell comparison of two results with a tolerance."""
    old, new = (d.select("k", F.col("v").cast("double").alias("v")) for d in _versions(spark, sf))
    return tables.tolerant_compare(old, new, ["k"], ["v"], 0.5).select("k", "left", "right", "status")


@query("""with e as (select o_custkey, o_orderkey, o_orderstatus as s, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) select o_custkey, o_orderkey, p || '>' || s as step from e where p = 'F' and s = 'O'""")
def bad_transitions(spark, sf):
    """V07: steps of a life cycle that the table of transitions does not allow."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = read_table(spark, sf, "orders").withColumn("p", F.lag("o_orderstatus").over(w)).where("p is not null")
    allowed = spark.createDataFrame([("O", "O"), ("O", "F"), ("O", "P"), ("P", "P"), ("P", "F"), ("P", "O"), ("F", "F"), ("F", "P")], "p string, o_orderstatus string")
    return steps.join(F.broadcast(allowed), ["p", "o_orderstatus"], "left_anti").select("o_custkey", "o_orderkey", F.concat("p", F.lit(">"), "o_orderstatus").alias("step"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null""")
def json_records(spark, sf):
    """SRC4 and SRC5: nested JSON records; lines that do not parse are dropped."""
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k long").getField("k").alias("k")).where("k is not null")


@query(r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents),
h as (select *, last_value(case when length(line) <= 40 then line end ignore nulls) over (partition by doc_id order by n rows unbounded preceding) as header from l)
select doc_id, n, cast(length(header) as bigint) as header_chars, cast(length(line) as bigint) as chars from h where length(line) > 40""")
def text_blocks(spark, sf):
    """SRC6 and EXT4: lines of a text under the header line above them."""
    lines = read_table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    header = F.last(F.when(F.length("line") <= 40, F.col("line")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("header", header).where(F.length("line") > 40).select("doc_id", (F.col("pos") + 1).cast("long").alias("n"), F.length("header").cast("long").alias("header_chars"), F.length("line").cast("long").alias("chars"))
