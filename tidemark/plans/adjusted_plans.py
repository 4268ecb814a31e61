"""Means by side and means adjusted for the opponent at a cutoff; the markets that a grid gives beside the main ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import grids
from tidemark.operators.adjusted import adjusted_form, opponent_adjusted, side_means
from tidemark.operators.asof import as_of
from tidemark.operators.tables import once_per
from tidemark.plans.asof_plans import ALL, ASK, LAST, OVER, _rows
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _GRID, _grid, _rates
from tidemark.sources.tables import CONTESTS, ENTITY

query = Registry()
_SIDE = "over (partition by entity_id, side order by available_at, contest_id rows between 9 preceding and current row)"
_LEVEL = "level as (select available_at, sum(sum(own_n)) over (order by available_at) / cast(sum(count(*)) over (order by available_at) as double) as mu from entity_rows group by 1)"


@query(f"""with {CONTESTS}, {ENTITY},
state as (select entity_id, side as at_side, available_at, case when count(*) {_SIDE} >= 3 then avg(own_n) {_SIDE} end as f, case when count(*) {_SIDE} >= 3 then avg(opp_n) {_SIDE} end as g from entity_rows {LAST.format(k="entity_id, side")}),
asked as (select contest_id, side, entity_id, cutoff, at_side from entity_rows, (values ('L'), ('R')) v(at_side)),
found as (select a.*, s.f, s.g from asked a asof left join state s on a.entity_id = s.entity_id and a.at_side = s.at_side and a.cutoff >= s.available_at)
select contest_id, side, max(f) filter (at_side = 'L') as for_left, max(g) filter (at_side = 'L') as against_left, max(f) filter (at_side = 'R') as for_right, max(g) filter (at_side = 'R') as against_right from found group by 1, 2""")
def means_by_side(spark, sf):
    """WIN7: means for and against over the last ten rows on either side known at the cutoff, at least three."""
    rows = _rows(spark, sf)
    return side_means(rows.select(*ASK), rows).drop("entity_id", "cutoff")


@query(f"""with {CONTESTS}, {ENTITY}, {_LEVEL},
s1 as (select entity_id, available_at, contest_id, case when count(*) {OVER.format(n=9)} >= 3 then list({{'o': opp_id, 'v': own_n}}) {OVER.format(n=9)} end as held, case when count(*) {ALL} >= 3 then avg(opp_n) {ALL} end as conceded from entity_rows),
state as (select * from s1 {LAST.format(k="entity_id")}),
asked as (select a.contest_id, a.side, a.cutoff, s.held from entity_rows a asof left join state s on a.entity_id = s.entity_id and a.cutoff >= s.available_at),
one as (select contest_id, side, cutoff, unnest(held) as m from asked),
each as (select contest_id, side, cutoff, m.o as o, m.v as v from one),
rated as (select e.contest_id, e.side, e.cutoff, e.v, s.conceded from each e asof left join state s on e.o = s.entity_id and e.cutoff >= s.available_at),
less as (select r.contest_id, r.side, avg(r.v - coalesce(r.conceded, l.mu)) as adjusted from rated r asof left join level l on r.cutoff >= l.available_at group by 1, 2)
select a.contest_id, a.side, l.adjusted from asked a left join less l using (contest_id, side)""")
def opponent_adjusted_mean(spark, sf):
    """WIN7: mean of what was scored less what each opponent concedes, all as known at the cutoff."""
    rows = _rows(spark, sf)
    return opponent_adjusted(rows.select(*ASK), rows).select("contest_id", "side", "adjusted")


@query(f"""with {CONTESTS}, {ENTITY}, {_LEVEL},
state as (select entity_id, available_at, sum(own_n) {ALL} as gf, sum(opp_n) {ALL} as ga, count(*) {ALL} as n from entity_rows {LAST.format(k="entity_id")}),
met as (select e.*, coalesce(s.gf, 0) as gf, coalesce(s.ga, 0) as ga, coalesce(s.n, 0) as n from entity_rows e asof left join state s on e.opp_id = s.entity_id and e.available_at > s.available_at),
levelled as (select m.*, coalesce(l.mu, 1.3) as mu from met m asof left join level l on m.available_at > l.available_at),
moves as (select entity_id, contest_id, available_at, own_n - (ga + 5 * mu) / (n + 5) as att, opp_n - (gf + 5 * mu) / (n + 5) as dfn from levelled),
form as (select entity_id, available_at, case when count(*) {OVER.format(n=9)} >= 3 then avg(att) {OVER.format(n=9)} end as att, case when count(*) {OVER.format(n=9)} >= 3 then avg(dfn) {OVER.format(n=9)} end as dfn from moves {LAST.format(k="entity_id")}),
asked as (select a.contest_id, a.side, f.att, f.dfn from entity_rows a asof left join form f on a.entity_id = f.entity_id and a.cutoff >= f.available_at),
wide as (select contest_id, max(att) filter (side = 'L') as left_att, max(dfn) filter (side = 'L') as left_def, max(att) filter (side = 'R') as right_att, max(dfn) filter (side = 'R') as right_def from asked group by 1)
select *, (left_att - left_def) - (right_att - right_def) as strength_gap, left_att is not null and right_att is not null as available from wide""")
def opponent_adjusted_form(spark, sf):
    """WIN8: form of both entities against what their opponents were worth before each contest, shrunk to the running mean of all, and the gap between the two."""
    rows = _rows(spark, sf)
    asked = as_of(rows.select(*ASK), adjusted_form(rows), ["entity_id"], "cutoff", "available_at", ["adj_att", "adj_def"])
    on = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = asked.groupBy("contest_id").agg(*[on(s, f"adj_{c}").alias(f"{n}_{c}") for s, n in (("L", "left"), ("R", "right")) for c in ("att", "def")])
    gap = (F.col("left_att") - F.col("left_def")) - (F.col("right_att") - F.col("right_def"))
    return wide.select("*", gap.alias("strength_gap"), (F.col("left_att").isNotNull() & F.col("right_att").isNotNull()).alias("available"))


_TOTALS = ", ".join(f"sum(p) filter (h + a = {k}) as total_{k}" for k in range(7))
_TEAM = ", ".join(f"coalesce(sum(p) filter ({c} > {k}), 0) as {n}_over_{k}_5" for c, n in (("h", "left"), ("a", "right")) for k in range(3))


@query(f"""with {_GRID} select contest_id, sum(p) filter (h >= a) as left_or_draw, sum(p) filter (h <> a) as no_draw, sum(p) filter (h <= a) as right_or_draw, sum(p) filter (h = 0) as right_clean,
sum(p) filter (h > a) / sum(p) filter (h <> a) as left_if_no_draw, sum(p) filter (h < a) / sum(p) filter (h <> a) as right_if_no_draw, {_TEAM}, {_TOTALS}, sum(p) filter (h + a >= 7) as total_7_up from cells group by 1""")
def side_markets(spark, sf):
    """PRB5: double chance, draw no bet, totals of either side and the distribution of the total, read off the grid in one pass."""
    own = lambda r: _grid(r).select("x", "y", grids.side_markets(F.col("grid")).alias("m"))
    return once_per(_rates(spark, sf).select("contest_id", "x", "y"), ["x", "y"], own).select("contest_id", "m.*")
