"""Fits and what they predict."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import fits
from tidemark.plans.registry import Registry
from tidemark.plans.score_plans import _M
from tidemark.sources.tables import CONTESTS, FORECASTS, contests, forecasts, models, outcome
from tidemark.storage import written

query = Registry()


@query(f"""with {CONTESTS}, {FORECASTS}, g as (select avg(cast(y = 0 as int)) as g0, avg(cast(y = 1 as int)) as g1, avg(cast(y = 2 as int)) as g2 from forecasts), p as (select pool, count(y) as n, sum(cast(y = 0 as int)) as a, sum(cast(y = 1 as int)) as b, sum(cast(y = 2 as int)) as c from forecasts group by 1)
select pool, (a + 50 * g0) / (n + 50) as q0, (b + 50 * g1) / (n + 50) as q1, (c + 50 * g2) / (n + 50) as q2 from p, g""")
def outcome_frequencies(spark, sf):
    """FIT1: outcome shares by pool, drawn to the overall ones."""
    return fits.frequencies(forecasts(contests(spark, sf)), "pool", "y")


@query()
def rating_replay(spark, sf):
    """FIT2: ratings before each contest from the results known by then, pools replayed apart."""
    c = contests(spark, sf).withColumn("y", outcome())
    return fits.elo(c, "pool", "event_ts", "available_at", "contest_id", "left_id", "right_id", "y")


@query()
def rating_outcomes(spark, sf):
    """FIT4: rating difference to the probability of each outcome, by two logistic thresholds fitted with Newton steps."""
    c = contests(spark, sf).withColumn("y", outcome())
    r = fits.elo(c, "pool", "event_ts", "available_at", "contest_id", "left_id", "right_id", "y").join(c.select("contest_id", "y"), "contest_id").withColumn("d", (F.col("left_rating") - F.col("right_rating")) / 100)
    r = written(r, "replayed")  # replayed once, for both thresholds and the result
    high, low = (fits.logistic(r, [F.col("d")], (F.col("y") <= k).cast("int"), steps=6) for k in (0, 1))
    p = lambda b: 1 / (1 + F.exp(-(F.lit(b[0]) + F.lit(b[1]) * F.col("d"))))
    return r.select("contest_id", p(high).alias("p0"), F.greatest(F.lit(0.0), p(low) - p(high)).alias("p1"), (1 - F.greatest(p(low), p(high))).alias("p2"))


@query()
def poisson_rates(spark, sf):
    """FIT5: attack and defence by iterative scaling with shrinkage."""
    home, away, p = fits.rates(contests(spark, sf), "left_id", "right_id", "left_n", "right_n", sweeps=4)
    return p.select("entity", F.round("attack", 6).alias("attack"), F.round("defence", 6).alias("defence"), F.lit(home).alias("home_level"), F.lit(away).alias("away_level"))


@query()
def low_score_dependence(spark, sf):
    """FIT7: likelihood of the low-score dependence by pool levels, at a grid refined twice."""
    c = contests(spark, sf)
    levels = c.groupBy("pool").agg(F.avg("left_n").alias("x"), F.avg("right_n").alias("v"))
    joined = c.join(F.broadcast(levels), "pool")
    rho = fits.low_score_rho(joined, "x", "v", "left_n", "right_n")
    return levels.withColumn("rho", F.lit(rho))


@query(f"""{_M}, c as (select model_id, contest_id, y, t, list_transform([p0, p1, p2], lambda p: pow(greatest(p, 1e-12), 1 / t)) as v from models, (select unnest([0.6, 0.8, 1.0, 1.25, 1.6, 2.0, 3.0]) as t)),
l as (select model_id, t, round(avg(-ln(greatest(v[y + 1] / list_sum(v), 1e-15))), 9) as loss from c group by 1, 2) select model_id, t as temperature, loss from l qualify row_number() over (partition by model_id order by loss, t) = 1""")
def temperature_grid(spark, sf):
    """FIT9 (grid): a temperature of least loss for each model, the whole grid in one aggregate."""
    p = F.array("p0", "p1", "p2")
    m = models(forecasts(contests(spark, sf)))
    m = m.groupBy("model_id", "p0", "p1", "p2", "y").agg(F.count("*").alias("n"))  # equal rows lose the same
    losses = {f"t{int(t * 100):04d}": scores.log_loss(scores.temperature(p, t), F.col("y")) for t in (0.6, 0.8, 1.0, 1.25, 1.6, 2.0, 3.0)}
    means = m.groupBy("model_id").agg(*[F.round(F.sum(F.col("n") * c) / F.sum(F.when(c.isNotNull(), F.col("n"))), 9).alias(n) for n, c in losses.items()])
    best = fits.best_of_grid(means, {n: F.col(n) for n in losses}, ["model_id"])
    return best.select("model_id", (F.substring("name", 2, 4).cast("double") / 100).alias("temperature"), F.round("loss", 9).alias("loss"))


@query()
def calibration_slope(spark, sf):
    """FIT11: Platt slope and intercept of each model's first outcome."""
    m = models(forecasts(contests(spark, sf)))
    rows = []
    for k in (1, 2, 3):  # three models, whatever the input's size
        logit = F.log(F.col("p0") / (1 - F.col("p0")))
        a, b = fits.logistic(m.where(F.col("model_id") == k), [logit], (F.col("y") == 0).cast("int"), steps=8)
        rows.append((k, round(a, 6), round(b, 6)))
    fitted = spark.createDataFrame(rows, "model_id int, intercept double, slope double")
    return m.groupBy("model_id").agg(F.count("*").alias("n"), F.avg("p0").alias("mean_stated"), F.avg((F.col("y") == 0).cast("int")).alias("rate")).join(F.broadcast(fitted), "model_id")


@query()
def isotonic_calibration(spark, sf):
    """FIT10: isotonic calibration of the first outcome on an earlier window, applied to all."""
    m = models(forecasts(contests(spark, sf))).where("model_id = 1").select("contest_id", "event_ts", "p0", (F.col("y") == 0).cast("double").alias("label"))
    fitted = IsotonicRegression(featuresCol="p0", labelCol="label", predictionCol="calibrated").fit(m.where("event_ts < timestamp '2024-01-15'").select("p0", "label"))
    return fitted.transform(m).select("contest_id", "p0", "calibrated")


@query()
def tree_forecast(spark, sf):
    """FIT12: boosted trees on the as-of features; missing values by flag and fill."""
    from tidemark.plans.asof_plans import form_last_n, rest_days

    c = contests(spark, sf)
    f = form_last_n(spark, sf).where("side = 'L'").join(rest_days(spark, sf).where("side = 'L'").select("contest_id", "rest_capped"), "contest_id")
    f = f.join(c.select("contest_id", "event_ts", (outcome() == 0).cast("double").alias("label")), "contest_id").withColumn("has_form", F.col("form5").isNotNull().cast("double")).fillna(5, ["form3", "form5", "form10"])
    f = written(f.select("contest_id", "event_ts", "label", "form3", "form5", "form10", "has_form", "rest_capped"), "tree-rows")  # the fit reads its rows several times
    x = VectorAssembler(inputCols=["form3", "form5", "form10", "has_form", "rest_capped"], outputCol="x").transform(f)
    model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=5, maxDepth=3, seed=1).fit(x.where("event_ts < timestamp '2024-01-15'"))
    return model.transform(x).select("contest_id", F.round(vector_to_array("probability").getItem(1), 6).alias("p0"))


@query(f"""{_M}, j as (select a.contest_id, a.y, a.pool, case a.y when 0 then a.p0 when 1 then a.p1 else a.p2 end as pa, case a.y when 0 then b.p0 when 1 then b.p1 else b.p2 end as pb from models a join models b using (contest_id) where a.model_id = 1 and b.model_id = 2),
l as (select pool, w / 10.0 as w, round(avg(-ln(greatest(w / 10.0 * pa + (1 - w / 10.0) * pb, 1e-15))), 9) as loss from j, range(11) r(w) group by 1, 2) select pool, cast(w as double) as weight, loss from l qualify row_number() over (partition by pool order by loss, w) = 1""")
def blend_weights(spark, sf):
    """FIT13 (grid): weights of a blend by pool, the grid in one aggregate."""
    m = models(forecasts(contests(spark, sf))).select("contest_id", "pool", "model_id", F.get(F.array("p0", "p1", "p2"), F.col("y")).alias("p"))
    j = m.where("model_id = 1").select("contest_id", "pool", F.col("p").alias("pa")).join(m.where("model_id = 2").select("contest_id", F.col("p").alias("pb")), "contest_id")
    losses = {f"w{w:02d}": -F.log(F.greatest(w / 10.0 * F.col("pa") + (1 - w / 10.0) * F.col("pb"), F.lit(1e-15))) for w in range(11)}
    means = j.groupBy("pool").agg(*[F.round(F.avg(c), 9).alias(n) for n, c in losses.items()])
    best = fits.best_of_grid(means, {n: F.col(n) for n in losses}, ["pool"])
    return best.select("pool", (F.substring("name", 2, 2).cast("double") / 10).alias("weight"), F.round("loss", 9).alias("loss"))


@query(f"""with {CONTESTS}, {FORECASTS}, b as (select *, cast(date_diff('day', timestamp '2024-01-01', date_trunc('day', event_ts)) // 7 as bigint) as block from forecasts), s as (select block, min(event_ts) as start_ts from b group by 1),
f as (select s.block, count(*) as n, avg(cast(f.y = 0 as int)) as q0 from s join forecasts f on f.available_at <= s.start_ts group by 1) select b.block, count(*) as rows_n, avg(-ln(greatest(case when y = 0 then q0 else 1 - q0 end, 1e-15))) as loss, max(f.n) as trained_on from b join f using (block) group by 1""")
def out_of_fold(spark, sf):
    """FIT14: refit by blocks on what was available before each, all blocks in one job by running sums."""
    f = forecasts(contests(spark, sf))
    b = f.withColumn("block", F.floor(F.datediff(F.to_date("event_ts"), F.lit("2024-01-01")) / 7))
    starts = b.groupBy("block").agg(F.min("event_ts").alias("start_ts"))
    # a row trains every block that starts once it is known: count it at the first such block, then run the sums over the blocks
    order = F.broadcast(starts.agg(F.sort_array(F.collect_list(F.struct("start_ts", "block"))).alias("all")))
    first = F.get(F.filter("all", lambda s: s.start_ts >= F.col("available_at")), 0).getField("block")
    sums = f.join(order).withColumn("block", first).where("block is not null").groupBy("block").agg(F.count("*").alias("n"), F.sum((F.col("y") == 0).cast("long")).alias("h"))
    from pyspark.sql import Window

    run = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fitted = starts.join(sums, "block", "left").fillna(0, ["n", "h"]).select("block", F.sum("n").over(run).alias("n"), F.sum("h").over(run).alias("h")).where("n > 0").withColumn("q0", F.col("h") / F.col("n"))
    loss = -F.log(F.greatest(F.when(F.col("y") == 0, F.col("q0")).otherwise(1 - F.col("q0")), F.lit(1e-15)))
    return b.join(F.broadcast(fitted), "block").groupBy("block").agg(F.count("*").alias("rows_n"), F.avg(loss).alias("loss"), F.max("n").alias("trained_on"))


@query()
def permutation_importance(spark, sf):
    """FIT17: loss with one weight of the vector taken from another row (a shift in hash order within the pool)."""
    from pyspark.sql import Window

    m = models(forecasts(contests(spark, sf))).where("model_id = 1")
    m = m.withColumn("lot", F.pmod(F.xxhash64(F.lit(3), "contest_id"), F.lit(64)))  # rows trade places within parts of a pool
    w = Window.partitionBy("pool", "lot").orderBy(F.xxhash64(F.lit(11), "contest_id"), "contest_id")
    traded = m.select("y", F.array("p0", "p1", "p2").alias("p"), *[F.coalesce(F.lag(f"p{k}").over(w), F.col(f"p{k}")).alias(f"t{k}") for k in range(3)])
    each = [F.struct(F.lit(f"p{k}").alias("feature"), F.array(*[F.col(f"t{i}") if i == k else F.col("p")[i] for i in range(3)]).alias("q")) for k in range(3)]
    rows = traded.select("y", "p", F.explode(F.array(*each)).alias("e")).select("y", "p", "e.*")
    s = scores.temperature(F.col("q"), 1.0)
    return rows.groupBy("feature").agg(F.round(F.avg(scores.log_loss(s, F.col("y")) - scores.log_loss(F.col("p"), F.col("y"))), 6).alias("importance"))


