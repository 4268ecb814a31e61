"""Suggestions for unknown names, usual members of sets, exact resampling, keyed calibrators and stacking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import grids, scores
from tidemark.operators import softmax
from tidemark.operators.features import usual_members
from tidemark.operators.resampling import bootstrap_interval
from tidemark.operators.suggest import suggestions, word_counts
from tidemark.plans.registry import Registry
from tidemark.sources.tables import CONTESTS, contests, forecasts, models, read_table
from tidemark.storage import written

query = Registry()
LEAST, OFTEN = 0.75, 20


@query(f"""with w as (select unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) as other from documents), known as (select other from w group by 1 having count(*) >= {OFTEN}),
names as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) as name from benchmark union select distinct unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) from conversations),
p as (select name, other, 1 - levenshtein(name, other) / greatest(length(name), length(other)) as similarity from names, known where name not in (select other from known))
select name, other, similarity, row_number() over (partition by name order by similarity desc, other) as rank from p where similarity >= {LEAST} - 1e-12 qualify row_number() over (partition by name order by similarity desc, other) <= 3""")
def name_suggestions(spark, sf):
    """RES4: words of two tables that the documents' frequent words lack, each with the three most similar of those."""
    text = lambda t: read_table(spark, sf, t).select("text")
    known = word_counts(text("documents"), "text", 5).where(F.col("n") >= OFTEN).select(F.col("word").alias("other"))
    return suggestions(word_counts(text("benchmark").union(text("conversations")), "text", 5).select(F.col("word").alias("name")), known, "name", "other", LEAST)


@query("""with b as (select o_custkey as c, o_orderkey as k, cast(o_orderdate as date) as d, list_sort(list_distinct(list(l_partkey))) as m from orders join lineitem on o_orderkey = l_orderkey group by 1, 2, 3),
h as (select b.k, p.m, row_number() over (partition by b.k order by p.d desc, p.k desc) as r from b join b p on p.c = b.c and p.d < b.d), five as (select * from h where r <= 5), n as (select k, count(*) as n from five group by 1),
e as (select k, unnest(m) as m from five), t as (select k, m, row_number() over (partition by k order by count(*) desc, m) as r from e group by k, m),
u as (select k, list(m order by r) as usual from t join n using (k) where n = 5 and r <= 11 group by k)
select b.k as o_orderkey, coalesce(n.n, 0) as sets_n, list_aggregate(usual, 'string_agg', ',') as usual, cast(len(list_filter(usual, lambda x: not list_contains(b.m, x))) as bigint) as missing_n from b left join n using (k) left join u using (k)""")
def usual_set(spark, sf):
    """WIN11: the usual eleven of the last five sets known before the day, and how many of them a set lacks."""
    b = read_table(spark, sf, "orders").join(read_table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day")).agg(F.collect_set("l_partkey").alias("parts"))
    return usual_members(b, "o_custkey", "day", "o_orderkey", "parts").select("o_orderkey", "sets_n", F.array_join("usual", ",").alias("usual"), "missing_n")


@query()
def row_bootstrap(spark, sf):
    """MET6: percentile interval of the mean count under row weights, values times draws."""
    return bootstrap_interval(contests(spark, sf), "left_n", draws=500, seed=3)


def _windows(spark, sf):
    m = models(forecasts(contests(spark, sf)))
    return m.withColumn("p", F.array("p0", "p1", "p2")).withColumn("early", F.col("event_ts") < F.expr("timestamp '2024-01-15'"))


@query()
def calibrators(spark, sf):
    """FIT9 and PRB11: four families of calibrators of every model, fitted on the earlier window and scored on the later one."""
    m = written(_windows(spark, sf).groupBy("model_id", "p", "y", "early").agg(F.count("*").alias("rows_n")), "calibrators")  # equal forecasts are one row
    mean = lambda x: F.sum(F.col("rows_n") * x) / F.sum("rows_n")
    out = None
    for name, family in softmax.CALIBRATORS.items():
        features, start = family(F.col("p"))
        fitted = softmax.fit(m.where("early"), ["model_id"], F.col("y"), features, start, ridge=1.0, weight=F.col("rows_n"))
        q = m.where("not early").join(fitted, "model_id").withColumn("q", softmax.probabilities(features, F.col("theta")))
        part = q.groupBy("model_id").agg(
            F.lit(name).alias("method"), F.first("status").alias("status"), F.first("n").alias("fit_n"), F.first("theta").alias("theta"), F.sum("rows_n").alias("n"),
            mean(scores.log_loss(F.col("p"), F.col("y"))).alias("loss_before"), mean(scores.log_loss(F.col("q"), F.col("y"))).alias("loss_after"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query()
def stacking(spark, sf):
    """FIT13: weights of a log-linear pool of two models by pool, fitted on the earlier window, against their plain mean on the later one."""
    m = _windows(spark, sf)
    both = m.where("model_id = 1").select("contest_id", "pool", "y", "early", F.col("p").alias("a")).join(m.where("model_id = 2").select("contest_id", F.col("p").alias("b")), "contest_id")
    features, start = softmax.stack([F.col("a"), F.col("b")])
    fitted = softmax.fit(both.where("early"), ["pool"], F.col("y"), features, start, ridge=5.0, least_rows=30)
    q = both.where("not early").join(fitted, "pool").withColumn("q", softmax.probabilities(features, F.col("theta"))).withColumn("plain", F.zip_with("a", "b", lambda x, z: (x + z) / 2))
    return q.groupBy("pool").agg(F.first("status").alias("status"), F.first("theta").alias("theta"), F.count("*").alias("n"), F.avg(scores.log_loss(F.col("q"), F.col("y"))).alias("loss"), F.avg(scores.log_loss(F.col("plain"), F.col("y"))).alias("loss_of_mean"))


#: Families of score grids with the shapes that are tried: nothing, the negative binomial's shape, the share of the lower rate that both sides have in common.
FAMILIES = {"poisson": (0.0,), "negative_binomial": (2.0, 4.0, 8.0, 16.0, 32.0), "bivariate": (0.02, 0.05, 0.1, 0.2, 0.3)}
MOST = 10
_PO = lambda x, k: f"exp(-({x}) + ({k}) * ln({x}) - lgamma(({k}) + 1))"
_NB = lambda x, k: f"exp(lgamma(shape + {k}) - lgamma(shape) - lgamma({k} + 1) + shape * ln(shape / (shape + {x})) + {k} * ln({x} / (shape + {x})))"
_COMMON = "(shape * least(l, r))"


@query(f"""with {CONTESTS}, e as (select *, event_ts < timestamp '2024-01-15' as early from contests), rates as (select pool, avg(left_n) as l, avg(right_n) as r from e where early group by 1),
shapes as (select * from (values {", ".join(f"('{f}', cast({s} as double))" for f, ss in FAMILIES.items() for s in ss)}) v(family, shape)),
cells as (select pool, family, shape, h, a, case family when 'poisson' then {_PO("l", "h")} * {_PO("r", "a")} when 'negative_binomial' then {_NB("l", "h")} * {_NB("r", "a")}
    else list_sum(list_transform(range(0, least(h, a) + 1), lambda c: {_PO(_COMMON, "c")} * {_PO(f"greatest(l - {_COMMON}, 1e-6)", "h - c")} * {_PO(f"greatest(r - {_COMMON}, 1e-6)", "a - c")})) end as p
    from rates, shapes, (select unnest(range(0, {MOST + 1})) as h), (select unnest(range(0, {MOST + 1})) as a)),
mass as (select pool, family, shape, sum(p) as m from cells group by 1, 2, 3),
n as (select pool, early, least(left_n, {MOST}) as h, least(right_n, {MOST}) as a, count(*) as n from e group by 1, 2, 3, 4),
s as (select family, shape, early, sum(n * -ln(greatest(p / m, 1e-15))) / sum(n) as nll, sum(n * m) / sum(n) as captured from n join cells using (pool, h, a) join mass using (pool, family, shape) group by 1, 2, 3),
w as (select a.family, a.shape, a.nll as fit_nll, b.nll as select_nll, a.captured from s a join s b on a.family = b.family and a.shape = b.shape and a.early and not b.early)
select family, shape, round(fit_nll, 9) as fit_nll, round(select_nll, 9) as select_nll, round(captured, 9) as captured, row_number() over (partition by family order by round(fit_nll, 12), shape) = 1 as chosen from w""")
def family_study(spark, sf):
    """PRB4 and FIT15: score families by likelihood, each with the shape that fits the earlier window best, and its loss on the later one; all shapes in one aggregate over distinct scores."""
    e = contests(spark, sf).withColumn("early", F.col("event_ts") < F.expr("timestamp '2024-01-15'"))
    rates = e.where("early").groupBy("pool").agg(F.avg("left_n").alias("l"), F.avg("right_n").alias("r"))
    tried = [(f, s) for f, ss in FAMILIES.items() for s in ss]
    grids_ = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("shape"), grids.family_cells(f, F.col("l"), F.col("r"), F.lit(s), MOST).alias("g")) for f, s in tried])
    cells = rates.select("pool", F.explode(grids_).alias("x")).select("pool", "x.family", "x.shape", "x.g.cells", "x.g.captured")
    n = e.groupBy("pool", "early", F.least("left_n", F.lit(MOST)).alias("h"), F.least("right_n", F.lit(MOST)).alias("a")).agg(F.count("*").alias("n")).join(cells, "pool")
    p = F.get(F.get("cells", F.col("h").cast("int")), F.col("a").cast("int"))
    nll = lambda early: F.sum(F.when(F.col("early") == early, F.col("n") * -F.log(F.greatest(p, F.lit(1e-15))))) / F.sum(F.when(F.col("early") == early, F.col("n")))
    held = F.sum(F.when(F.col("early"), F.col("n") * F.col("captured"))) / F.sum(F.when(F.col("early"), F.col("n")))
    s = n.groupBy("family", "shape").agg(nll(True).alias("fit"), nll(False).alias("sel"), held.alias("held"))
    best = Window.partitionBy("family").orderBy(F.round("fit", 12), "shape")  # one row a shape
    return s.select("family", "shape", F.round("fit", 9).alias("fit_nll"), F.round("sel", 9).alias("select_nll"), F.round("held", 9).alias("captured"), (F.row_number().over(best) == 1).alias("chosen"))
