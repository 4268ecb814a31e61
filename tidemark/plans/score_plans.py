"""Prices, grids, scoring rules, calibration tables, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import grids, scores
from tidemark.operators import prices
from tidemark.operators.resampling import block_bootstrap, holm
from tidemark.operators.tables import once_per
from tidemark.plans.registry import Registry
from tidemark.sources.tables import CONTESTS, FORECASTS, MODELS, QUOTES, contests, forecasts, models, quotes

query = Registry()


def _p():
    return F.array("p0", "p1", "p2")

_TRIPLE = f"""{QUOTES}, l as (select contest, maker, outcome, arg_max(price, seq) as price from quotes group by 1, 2, 3),
t as (select contest, maker, max(case when outcome = 0 then price end) as a, max(case when outcome = 1 then price end) as b, max(case when outcome = 2 then price end) as c from l group by 1, 2 having count(*) = 3)"""


def _triples(spark, sf) -> DataFrame:
    last = quotes(spark, sf).groupBy("contest", "maker", "outcome").agg(F.max_by("price", "seq").alias("price"))
    return last.groupBy("contest", "maker").pivot("outcome", [0, 1, 2]).agg(F.first("price")).toDF("contest", "maker", "a", "b", "c").dropna().withColumn("prices", F.array("a", "b", "c"))


@query(f"with {_TRIPLE}, q as (select *, 1 / a + 1 / b + 1 / c as s from t) select contest, maker, s - 1 as overround, 1 / a / s as q0, 1 / b / s as q1, 1 / c / s as q2, a * 0.4 - 1 as ev, ln(a) - ln(b) as clv from q")
def fair_prices(spark, sf):
    """PRB1 and PRB2: implied probabilities, overround, margin removed in proportion, expected value."""
    q = prices.remove_margin(F.col("prices"))
    return _triples(spark, sf).select("contest", "maker", prices.overround(F.col("prices")).alias("overround"), *[F.get(q, i).alias(f"q{i}") for i in range(3)], (F.col("a") * 0.4 - 1).alias("ev"), (F.log("a") - F.log("b")).alias("clv"))


@query()
def fair_prices_power(spark, sf):
    """PRB2: margins removed by the power and the Shin method (bisection in native expressions)."""
    t = _triples(spark, sf)
    for m in ("power", "shin"):
        t = t.withColumn(m, prices.remove_margin(F.col("prices"), m))
    return t.select("contest", "maker", *[F.round(F.get(m, i), 6).alias(f"{m}{i}") for m in ("power", "shin") for i in range(3)])


@query(f"with {_TRIPLE}, q as (select contest, 1 / a / (1 / a + 1 / b + 1 / c) as q0, a from t) select contest, count(*) as makers, avg(q0) as mean0, coalesce(stddev_pop(q0), 0) as spread0, max(a) as best0 from q group by 1")
def consensus(spark, sf):
    """AGG12: consensus of makers, dispersion and best price."""
    t = _triples(spark, sf).withColumn("q0", F.get(prices.remove_margin(F.col("prices")), 0))
    return t.groupBy("contest").agg(F.count("*").alias("makers"), F.avg("q0").alias("mean0"), F.coalesce(F.stddev_pop("q0"), F.lit(0.0)).alias("spread0"), F.max("a").alias("best0"))


def _rates(spark, sf) -> DataFrame:
    c = contests(spark, sf)
    return c.select("contest_id", (F.lit(0.6) + (F.col("left_id") % 9) / F.lit(5.0)).alias("x"), (F.lit(0.5) + (F.col("right_id") % 7) / F.lit(5.0)).alias("y"), "left_n", "right_n")


_RATES = "rates as (select contest_id, cast(0.6 as double) + (left_id % 9) / cast(5 as double) as x, cast(0.5 as double) + (right_id % 7) / cast(5 as double) as y, left_n, right_n from contests)"
_PMF = "[exp(-{r})" + "".join(f", exp(-{{r}}) * pow({{r}}, {k}) / {__import__('math').factorial(k)}" for k in range(1, 8)) + "]"
_GRID = f"""{CONTESTS}, {_RATES}, pm as (select *, {_PMF.format(r='x')} as px, {_PMF.format(r='y')} as py from rates),
pf as (select contest_id, x, y, left_n, right_n, list_append(px, greatest(0, 1 - list_sum(px))) as px, list_append(py, greatest(0, 1 - list_sum(py))) as py from pm),
cells0 as (select contest_id, left_n, right_n, h, a, px[h + 1] * py[a + 1] * case when h = 0 and a = 0 then 1 + x * y * 0.05 when h = 0 and a = 1 then 1 - x * 0.05 when h = 1 and a = 0 then 1 - y * 0.05 when h = 1 and a = 1 then 1.05 else 1 end as p
    from pf, range(9) g(h), range(9) k(a)),
cells as (select contest_id, left_n, right_n, h, a, p / sum(p) over (partition by contest_id) as p from cells0)"""


def _grid(rates: DataFrame) -> DataFrame:
    """px, py and grid of rates x and y."""
    r, x, y = rates, F.col("x"), F.col("y")
    r = r.withColumns({"px": grids.poisson_pmf(x, 8), "py": grids.poisson_pmf(y, 8)})
    return r.withColumn("grid", grids.score_grid(F.col("px"), F.col("py"), F.lit(-0.05), (x, y)))


@query(f"""with {_GRID} select contest_id, sum(p) filter (h > a) as p_left, sum(p) filter (h = a) as p_draw, sum(p) filter (h < a) as p_right, sum(p) filter (h > 0 and a > 0) as both_score, sum(p) filter (a = 0) as left_clean,
sum(p) filter (h - a > 1) as handicap_left, sum(h * p) as mean_left, sum(a * p) as mean_right, sum(p) filter (h + a > 1.5) as over_1_5, sum(p) filter (h + a > 2.5) as over_2_5, sum(p) filter (h + a > 3.5) as over_3_5 from cells group by 1""")
def grid_markets(spark, sf):
    """PRB3 to PRB5: Poisson pmfs, corrected score grid and the probabilities read off it, without a UDF."""
    own = lambda r: _grid(r).select("x", "y", grids.markets(F.col("grid")).alias("m"))
    return once_per(_rates(spark, sf).select("contest_id", "x", "y"), ["x", "y"], own).select("contest_id", "m.*")


@query(f"""with {_GRID}, o as (select *, row_number() over (partition by contest_id order by -round(p, 12), h, a) as k from cells),
t as (select contest_id, string_agg(h || '-' || a, ',' order by k) filter (k <= 3) as top3, min(k) filter (h = least(left_n, 8) and a = right_n) as hit_rank, sum(p) filter (h = left_n and a = right_n) as p_hit from o group by 1)
select contest_id, top3, hit_rank = 1 as top1, hit_rank <= 3 as in_top3, -ln(greatest(p_hit, 1e-15)) as exact_loss from t""")
def exact_scores(spark, sf):
    """MET5 and SRT2: likeliest cells, exact-score hits and loss."""
    def own(rates: DataFrame) -> DataFrame:
        g = _grid(rates)
        cell = F.concat_ws("-", "left_n", "right_n")
        g = g.withColumn("top", grids.top_cells(F.col("grid"), 3))
        p = grids.region(F.col("grid"), lambda h, a: (h == F.col("left_n")) & (a == F.col("right_n")))
        return g.select(*keys, F.array_join("top", ",").alias("top3"), (F.get("top", 0) == cell).alias("top1"), F.array_contains("top", cell).alias("in_top3"), (-F.log(F.greatest(p, F.lit(1e-15)))).alias("exact_loss"))

    keys = ["x", "y", "left_n", "right_n"]
    return once_per(_rates(spark, sf), keys, own).select("contest_id", "top3", "top1", "in_top3", "exact_loss")


@query(f"""with {_GRID}, r as (select contest_id, h, a, p, sum(case when h > a then p end) over w as l, sum(case when h = a then p end) over w as d, sum(case when h < a then p end) over w as g from cells window w as (partition by contest_id))
select contest_id, sum(p * case when h > a then 0.5 / l when h = a then 0.3 / d else 0.2 / g end) filter (h + a > 2.5) as over_2_5, sum(p * case when h > a then 0.5 / l when h = a then 0.3 / d else 0.2 / g end) as mass from r group by 1""")
def rescaled_grid(spark, sf):
    """PRB6: the grid scaled to a blended headline."""
    def own(rates: DataFrame) -> DataFrame:
        g = _grid(rates).withColumn("new", grids.rescale(F.col("grid"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))))
        return g.select("x", "y", grids.region(F.col("new"), lambda h, a: h + a > 2.5).alias("over_2_5"), grids.region(F.col("new"), lambda h, a: F.lit(True)).alias("mass"))

    return once_per(_rates(spark, sf).select("contest_id", "x", "y"), ["x", "y"], own).select("contest_id", "over_2_5", "mass")


@query(f"""with {_GRID}, c as (select contest_id, h + a as k, sum(px[h + 1] * py[a + 1]) as p from pf, range(9) g(h), range(9) j(a) group by 1, 2) select contest_id, sum(p) filter (k <= 2) as under_2_5, sum(k * p) as mean_total from c group by 1""")
def total_counts(spark, sf):
    """PRB7: distribution of the total by convolution."""
    t = grids.convolve(F.col("px"), F.col("py"))
    own = lambda r: _grid(r).select("x", "y", prices.total(F.slice(t, 1, 3)).alias("under_2_5"), prices.total(F.transform(t, lambda p, k: k * p)).alias("mean_total"))
    return once_per(_rates(spark, sf).select("contest_id", "x", "y"), ["x", "y"], own).select("contest_id", "under_2_5", "mean_total")


_M = f"with {CONTESTS}, {FORECASTS}, {MODELS}"
_LOSS = """-ln(least(greatest(case y when 0 then p0 when 1 then p1 else p2 end, 1e-15), 1 - 1e-15))"""
_BRIER = "pow(p0 - cast(y = 0 as int), 2) + pow(p1 - cast(y = 1 as int), 2) + pow(p2 - cast(y = 2 as int), 2)"
_RPS = "(pow(p0 - cast(y <= 0 as int), 2) + pow(p0 + p1 - cast(y <= 1 as int), 2)) / 2"
_ACC = "case when case y when 0 then p0 when 1 then p1 else p2 end = greatest(p0, p1, p2) then 1.0 / (cast(p0 = greatest(p0, p1, p2) as int) + cast(p1 = greatest(p0, p1, p2) as int) + cast(p2 = greatest(p0, p1, p2) as int)) else 0 end"


def _scored(spark, sf) -> DataFrame:
    m = models(forecasts(contests(spark, sf)))
    return m.withColumns({n: scores.metric(n, _p(), F.col("y")) for n in scores.METRICS})


@query(f"{_M} select model_id, contest_id, {_LOSS} as log_loss, {_BRIER} as brier, {_RPS} as rps, {_ACC} as accuracy from models")
def row_scores(spark, sf):
    """MET1, MET2, EXT3: log loss, Brier, ranked score and accuracy of each forecast."""
    return _scored(spark, sf).select("model_id", "contest_id", *scores.METRICS)


@query(f"""{_M} select model_id, pool, strftime(season, '%Y-%m-%d') as season, grouping(pool) as g_pool, grouping(season) as g_season, count(*) as n, avg({_LOSS}) as log_loss, avg({_BRIER}) as brier, avg({_RPS}) as rps from models
group by grouping sets ((model_id), (model_id, pool), (model_id, season), (model_id, pool, season))""")
def scope_leaderboard(spark, sf):
    """AGG7: mean scores overall, by pool, by season and by both."""
    s = _scored(spark, sf)
    s.createOrReplaceTempView("__scored")
    return spark.sql("""select model_id, pool, date_format(season, 'yyyy-MM-dd') as season, cast(grouping(pool) as bigint) as g_pool, cast(grouping(season) as bigint) as g_season, count(*) as n, avg(log_loss) as log_loss, avg(brier) as brier, avg(rps) as rps
        from __scored group by grouping sets ((model_id), (model_id, pool), (model_id, season), (model_id, pool, season))""")


@query(f"""{_M}, f as (select model_id, season, count(*) as n, avg({_LOSS}) as m from models group by 1, 2) select model_id, avg(m) as mean, sum(m * n) / sum(n) as weighted, stddev_pop(m) as sd, min(m) as low, max(m) as high from f group by 1""")
def fold_summary(spark, sf):
    """AGG8: mean, weighted mean, deviation and range over folds."""
    f = _scored(spark, sf).groupBy("model_id", "season").agg(F.count("*").alias("n"), F.avg("log_loss").alias("m"))
    return f.groupBy("model_id").agg(F.avg("m").alias("mean"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"), F.stddev_pop("m").alias("sd"), F.min("m").alias("low"), F.max("m").alias("high"))


@query(f"""{_M}, b as (select model_id, greatest(p0, p1, p2) as c, {_ACC} as hit from models), k as (select model_id, least(9, cast(floor((c - 1.0 / 3) / (2.0 / 3) * 10) as bigint)) as bin, c, hit from b)
select model_id, bin, count(*) as n, avg(c) as stated, avg(hit) as seen, abs(avg(c) - avg(hit)) as gap from k group by 1, 2""")
def reliability(spark, sf):
    """MET4: reliability table of the top label; only bins that hold rows."""
    s = _scored(spark, sf).withColumn("c", F.greatest("p0", "p1", "p2"))
    bin_ = F.least(F.lit(9), F.floor((F.col("c") - 1.0 / 3) / (2.0 / 3) * 10)).cast("long")
    return s.groupBy("model_id", bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("c").alias("stated"), F.avg("accuracy").alias("seen"), F.abs(F.avg("c") - F.avg("accuracy")).alias("gap"))


@query(f"""{_M}, r as (select model_id, p0, y = 0 as pos, rank() over (partition by model_id order by p0) as lo, count(*) over (partition by model_id, p0) as peers from models)
select model_id, (sum(lo + (peers - 1) / 2.0) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0) / (count(*) filter (pos) * count(*) filter (not pos)) as auc from r group by 1""")
def binary_auc(spark, sf):
    """MET3: area under the curve with averaged ties. Values are counted first, so the ranking runs over distinct values."""
    m = models(forecasts(contests(spark, sf)))
    v = m.groupBy("model_id", "p0").agg(F.count("*").alias("n"), F.sum((F.col("y") == 0).cast("long")).alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("model_id").orderBy("p0").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("rank", before + (F.col("n") + 1) / 2.0)
    s = v.groupBy("model_id").agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("k"), F.sum("n").alias("n"))
    return s.select("model_id", ((F.col("r") - F.col("k") * (F.col("k") + 1) / 2.0) / (F.col("k") * (F.col("n") - F.col("k")))).alias("auc"))


@query(f"{_M} select model_id, contest_id, -(p0 * ln(p0) + p1 * ln(p1) + p2 * ln(p2)) as entropy, greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2)) as top_margin from models")
def uncertainty(spark, sf):
    """PRB9: entropy and top-two margin."""
    return models(forecasts(contests(spark, sf))).select("model_id", "contest_id", scores.entropy(_p()).alias("entropy"), scores.margin(_p()).alias("top_margin"))


@query(f"{_M} select contest_id, count(*) as n_models, avg(p0) as p0, avg(p1) as p1, avg(p2) as p2 from models group by 1")
def blend(spark, sf):
    """PRB10: mean of the models that did not abstain."""
    return models(forecasts(contests(spark, sf))).groupBy("contest_id").agg(F.count("*").alias("n_models"), *[F.avg(f"p{i}").alias(f"p{i}") for i in range(3)])


@query(f"{_M}, t as (select contest_id, model_id, pow(p0, 1 / 1.5) as a, pow(p1, 1 / 1.5) as b, pow(p2, 1 / 1.5) as c from models) select contest_id, model_id, a / (a + b + c) as t0, b / (a + b + c) as t1, c / (a + b + c) as t2 from t")
def tempered(spark, sf):
    """PRB11: a temperature applied to vectors."""
    t = scores.temperature(_p(), 1.5)
    return models(forecasts(contests(spark, sf))).select("contest_id", "model_id", *[F.get(t, i).alias(f"t{i}") for i in range(3)])


@query()
def bootstrap_by_week(spark, sf):
    """MET6 and MET7: block bootstrap by ISO week of mean losses and their paired difference."""
    s = _scored(spark, sf).where("model_id in (1, 2)")
    week = F.concat(F.expr("extract(yearofweek from event_ts)"), F.lit("-"), F.weekofyear("event_ts"))
    pairs = s.groupBy("contest_id", week.alias("block")).pivot("model_id", [1, 2]).agg(F.first("log_loss")).toDF("contest_id", "block", "a", "b")
    return block_bootstrap(pairs.withColumn("delta", F.col("a") - F.col("b")), "block", ["a", "b", "delta"], draws=500, seed=7)


@query(f"""{_M}, p as (select pool, model_id, avg({_LOSS}) as m from models group by 1, 2), h as (select pool, model_id, m, row_number() over (order by m, pool, model_id) as k, count(*) over () as n from p)
select pool, model_id, bool_and(m / 100 <= 0.05 / (n - k + 1)) over (order by k rows unbounded preceding) as passes from h""")
def holm_steps(spark, sf):
    """MET11: Holm's step-down over many hypotheses."""
    p = _scored(spark, sf).groupBy("pool", "model_id").agg((F.avg("log_loss") / 100).alias("p"))
    return holm(p, "p", ["pool", "model_id"], 0.05).select("pool", "model_id", "passes")


@query(f"""{_M}, v as (select contest_id, event_ts, y from models where model_id = 1), w as (select contest_id, (1 + count(*) filter (y = 0) over o) / (3.0 + count(*) over o) as prior0 from v window o as (order by event_ts, contest_id rows between unbounded preceding and 1 preceding)) select contest_id, prior0 from w""")
def expanding_prior(spark, sf):
    """WIN12: expanding prevalence with a Laplace prior, earlier rows only; days are summed first, so no window holds all rows."""
    v = models(forecasts(contests(spark, sf))).where("model_id = 1").select("contest_id", "event_ts", (F.col("y") == 0).cast("long").alias("hit"), F.to_date("event_ts").alias("day"))
    days = v.groupBy("day").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(earlier), F.lit(0)).alias("h0"))
    inside = Window.partitionBy("day").orderBy("event_ts", "contest_id").rowsBetween(Window.unboundedPreceding, -1)
    out = v.join(days, "day")
    hits, n = F.col("h0") + F.coalesce(F.sum("hit").over(inside), F.lit(0)), F.col("n0") + F.count("*").over(inside)
    return out.select("contest_id", ((1 + hits) / (3.0 + n)).alias("prior0"))
