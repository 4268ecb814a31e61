"""Penalised Poisson rates, one model a key (pool, season, ...), by exact block-coordinate steps: all models in one aggregate a step.

A side's count has the rate exp(attack of its entity - defence of the other + x h): x is 1 for the left side, 0 for the right one and one half for
both where the venue is neutral; h is the model's edge. Attacks are drawn to the model's level plus their group's term (plus a prior, if
given), defences to their group's term (less the prior), group terms to zero. The penalised likelihood is convex, and each of its blocks
(attacks, defences, edge with level, levels with group terms) has its exact minimum from one sum a key. A sweep is two joins and aggregates over cells of rows
that share model, sides and venue; level, edge and gradient come from the entities' sums of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Penalties of attacks, defences and the group terms of both, in units of expected counts.
RIDGE = {"attack": 4.0, "defence": 4.0, "attack_group": 2.0, "defence_group": 2.0, "edge": 1e-3}


def _root(v: Column, e: Column, y: Column, penalty: float, mean: Column) -> Column:
    """Where e exp(v) - y + penalty (v - mean) vanishes: safe Newton steps on sums alone."""

    def step(v: Column, _: Column) -> Column:
        return v - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (e * F.exp(v) - y + penalty * (v - mean)) / (e * F.exp(v) + penalty)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), v, step)


def _level_and_edge(edge: Column, home: Column, away: Column, half: Column, total: Column, tilt: Column, penalty: float) -> Column:
    """struct<rise, edge>: by how much all attacks rise, and the edge, at their joint minimum; home, away and half are the rates' sums by venue without edge."""

    def step(s: Column, _: Column) -> Column:
        a, b, c = home * F.exp(s.rise + s.edge), away * F.exp(s.rise), half * F.exp(s.rise + s.edge / 2)
        gr, ge = a + b + c - total, a + c / 2 - tilt + penalty * s.edge
        hrr, hre, hee = a + b + c, a + c / 2, a + c / 4 + penalty
        det = F.greatest(hrr * hee - hre * hre, F.lit(1e-300))
        clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
        return F.struct((s.rise - clip((hee * gr - hre * ge) / det)).alias("rise"), (s.edge - clip((hrr * ge - hre * gr) / det)).alias("edge"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.struct(F.lit(0.0).alias("rise"), edge.alias("edge")), step)


def cells(rows: DataFrame, model: Column, left: str, right: str, left_n: str, right_n: str, neutral: Column, weight: Column) -> DataFrame:
    """(model, own, opp, x, w, y, yy): both sides of the rows, added up where they have the same rate. Rows without counts are left out."""
    side = lambda own, opp, n, x: F.struct(F.col(own).alias("own"), F.col(opp).alias("opp"), F.col(n).cast("double").alias("n"), F.when(neutral, 0.5).otherwise(x).alias("x"))
    sides = rows.select(model.alias("model"), weight.cast("double").alias("weight"), F.explode(F.array(side(left, right, left_n, 1.0), side(right, left, right_n, 0.0))).alias("s")).select("model", "weight", "s.*").dropna()
    return sides.groupBy("model", "own", "opp", "x").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("n")).alias("y"), F.sum(F.col("weight") * F.col("n") ** 2).alias("yy"))


def _means(p: DataFrame, ridge: dict[str, float]) -> DataFrame:
    """p with the means that attacks and defences are drawn to, best for the present values; defences are first shifted, with attacks, to cost least."""
    ra, rd, ga, gd = (ridge[k] for k in ("attack", "defence", "attack_group", "defence_group"))
    g = p.groupBy("model", "grp").agg(F.count("*").alias("n"), F.avg(F.col("attack") - F.col("prior")).alias("a"), F.avg(F.col("defence") + F.col("prior")).alias("s"))
    all_of = Window.partitionBy("model")  # one row a group
    ka, kd = ra * F.col("n") * ga / (ra * F.col("n") + ga), rd * F.col("n") * gd / (rd * F.col("n") + gd)
    g = g.withColumn("level", F.sum(ka * F.col("a")).over(all_of) / F.sum(ka).over(all_of)).withColumn("shift", F.sum(kd * F.col("s")).over(all_of) / F.sum(kd).over(all_of))
    attack_term = ra * F.col("n") * (F.col("a") - F.col("level")) / (ra * F.col("n") + ga)
    defence_term = rd * F.col("n") * (F.col("s") - F.col("shift")) / (rd * F.col("n") + gd)
    g = g.select("model", "grp", (F.col("level") - F.col("shift")).alias("level"), "shift", attack_term.alias("attack_term"), defence_term.alias("defence_term"))
    own = p.drop("level", "attack_term", "defence_term").join(g, ["model", "grp"])
    return own.withColumn("attack", F.col("attack") - F.col("shift")).withColumn("defence", F.col("defence") - F.col("shift")).drop("shift")


def fit(rows: DataFrame, left: str, right: str, left_n: str, right_n: str, model: Column, group: Column | None = None, neutral: Column | None = None, weight: Column | None = None,
        prior: DataFrame | None = None, ridge: dict[str, float] = RIDGE, sweeps: int = 30, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(parameters, levels) of every model.

    parameters: model, entity, grp, attack, defence, attack_term, defence_term; levels: model, level, edge, dispersion (by moments: the variance is rate + dispersion
    rate^2), rows_n (weighted sides), gradient (largest entry of the penalised likelihood's gradient by attack, defence and edge). group: of an entity, in terms of a
    column `entity`; prior: (entity, prior). It stops when no model's gradient passes `tolerance` times its largest curvature, or after `sweeps`.
    """
    none = F.lit(False)
    data = written(cells(rows, model, left, right, left_n, right_n, none if neutral is None else neutral, F.lit(1.0) if weight is None else weight), "rate-cells")
    end = lambda e, t, f: F.struct(F.col(e).alias("entity"), t.alias("own_y"), f.alias("opp_y"))
    ends = data.select("model", F.explode(F.array(end("own", F.col("y"), F.lit(0.0)), end("opp", F.lit(0.0), F.col("y")))).alias("s")).select("model", "s.*")
    p = ends.groupBy("model", "entity").agg(F.sum("own_y").alias("own_y"), F.sum("opp_y").alias("opp_y")).withColumn("grp", F.lit("all") if group is None else group.cast("string"))
    p = p.join(prior, "entity", "left").fillna(0.0, ["prior"]) if prior is not None else p.withColumn("prior", F.lit(0.0))
    at = lambda x: F.sum(F.when(F.col("x") == x, F.col("y")).otherwise(0.0))
    of_model = written(data.groupBy("model").agg(F.log(F.greatest(F.sum("y") / F.sum("w"), F.lit(1e-3))).alias("start"), F.sum("y").alias("total"), (at(1.0) + at(0.5) / 2).alias("tilt")), "rate-models")
    p = p.join(of_model.select("model", "start"), "model").withColumns({"attack": F.col("start"), "defence": F.lit(0.0), "edge": F.lit(0.0), "steep": F.lit(None).cast("double")}).drop("start")
    p = written(_means(p, ridge), "rates")
    for _ in range(sweeps):
        # what the attacks meet, which also tells the gradient where the last sweep ended
        sums = data.join(p.select("model", F.col("entity").alias("opp"), "defence", "edge"), ["model", "opp"]).groupBy("model", F.col("own").alias("entity")).agg(F.sum(F.col("w") * F.exp(F.col("x") * F.col("edge") - F.col("defence"))).alias("e"))
        mean = F.col("level") + F.col("attack_term") + F.col("prior")
        met = p.join(sums, ["model", "entity"], "left").fillna(0.0, ["e"]).withColumn("m", F.col("e") * F.exp("attack"))
        steep = F.greatest(F.abs(F.col("m") - F.col("own_y") + ridge["attack"] * (F.col("attack") - mean)), F.col("steep"))
        moved = written(met.withColumn("steep", F.when(F.col("steep").isNotNull(), steep)).withColumn("attack", _root(F.col("attack"), F.col("e"), F.col("own_y"), ridge["attack"], mean)).drop("e"), "rates-attack")
        if moved.groupBy("model").agg(F.max("steep").alias("g"), F.sum("m").alias("m")).where(F.col("g").isNull() | (F.col("g") > tolerance * F.col("m"))).isEmpty():
            break
        # what the defences meet by venue: with the new defences these are the sums that level and edge need
        by = lambda x, n: F.sum(F.when(F.col("x") == x, F.col("w") * F.exp("attack")).otherwise(0.0)).alias(n)
        sums = data.join(moved.select("model", F.col("entity").alias("own"), "attack"), ["model", "own"]).groupBy("model", F.col("opp").alias("entity")).agg(by(1.0, "home"), by(0.0, "away"), by(0.5, "half"))
        venues = ["home", "away", "half"]
        p = moved.drop("m", "steep").join(sums, ["model", "entity"], "left").fillna(0.0, venues)
        e = F.col("home") * F.exp("edge") + F.col("away") + F.col("half") * F.exp(F.col("edge") / 2)
        p = p.withColumn("defence", -_root(-F.col("defence"), e, F.col("opp_y"), ridge["defence"], F.col("prior") - F.col("defence_term")))
        p = written(p.withColumns({v: F.col(v) * F.exp(-F.col("defence")) for v in venues}), "rates-defence")
        whole = p.groupBy("model").agg(*[F.sum(v).alias(v) for v in venues], F.first("edge").alias("edge")).join(of_model, "model")
        both = whole.select("model", *venues, "tilt", _level_and_edge(F.col("edge"), *(F.col(c) for c in (*venues, "total", "tilt")), ridge["edge"]).alias("b"))
        both = both.select("model", "b.rise", "b.edge", F.abs(F.exp("b.rise") * (F.col("home") * F.exp("b.edge") + F.col("half") * F.exp(F.col("b.edge") / 2) / 2) - F.col("tilt") + ridge["edge"] * F.col("b.edge")).alias("tilted"))
        p = _means(p.drop("edge"), ridge).join(both, "model").withColumn("attack", F.col("attack") + F.col("rise")).withColumn("level", F.col("level") + F.col("rise"))
        m = F.exp("rise") * (F.col("home") * F.exp("edge") + F.col("away") + F.col("half") * F.exp(F.col("edge") / 2))
        steep = F.greatest(F.abs(F.col("opp_y") - m + ridge["defence"] * (F.col("defence") - F.col("defence_term") + F.col("prior"))), "tilted")
        p = written(p.withColumn("steep", steep).drop("rise", "tilted", *venues), "rates")
    levels = written(_levels(data, p.drop("edge"), p.groupBy("model").agg(F.first("edge").alias("edge")), ridge), "levels")
    return p.select("model", "entity", "grp", "attack", "defence", "attack_term", "defence_term"), levels.drop("curvature")


def _sides(data: DataFrame, p: DataFrame) -> DataFrame:
    own, opp = p.select("model", F.col("entity").alias("own"), "attack"), p.select("model", F.col("entity").alias("opp"), "defence")
    return data.join(own, ["model", "own"]).join(opp, ["model", "opp"])


def _levels(data: DataFrame, p: DataFrame, edge: DataFrame, ridge: dict[str, float]) -> DataFrame:
    rate = F.exp(F.col("attack") - F.col("defence") + F.col("x") * F.col("edge"))
    at = _sides(data, p).join(edge, "model").withColumn("rate", rate).withColumn("m", F.col("w") * F.col("rate"))
    gap = F.col("m") - F.col("y")
    whole = at.groupBy("model").agg(
        F.sum("w").alias("rows_n"), F.sum(F.col("yy") - 2 * F.col("rate") * F.col("y") + F.col("rate") * F.col("m") - F.col("m")).alias("over"), F.sum(F.col("rate") * F.col("m")).alias("square"),
        F.sum(gap * F.col("x")).alias("g"), F.sum("m").alias("curvature"),
    ).join(edge, "model")
    part = lambda kind, e, g: F.struct(F.lit(kind).alias("kind"), F.col(e).alias("entity"), g.alias("g"))
    keyed = at.select("model", F.explode(F.array(part("a", "own", gap), part("d", "opp", -gap))).alias("s")).select("model", "s.*").groupBy("model", "kind", "entity").agg(F.sum("g").alias("g"))
    pull = F.when(F.col("kind") == "a", ridge["attack"] * (F.col("attack") - F.col("level") - F.col("attack_term") - F.col("prior"))).otherwise(ridge["defence"] * (F.col("defence") - F.col("defence_term") + F.col("prior")))
    steep = keyed.join(p, ["model", "entity"]).groupBy("model").agg(F.max(F.abs(F.col("g") + pull)).alias("steep"), F.first("level").alias("level"))
    return whole.join(steep, "model").select(
        "model", "level", "edge", F.greatest(F.lit(0.0), F.col("over") / F.col("square")).alias("dispersion"), "rows_n",
        F.greatest("steep", F.abs(F.col("g") + ridge["edge"] * F.col("edge"))).alias("gradient"), "curvature",
    )


def expected(contests: DataFrame, parameters: DataFrame, levels: DataFrame, model: str, left: str, right: str, neutral: Column | None = None) -> DataFrame:
    """contests with left_rate and right_rate; entities that a model has not seen take its level, contests of unknown models get null."""
    x = F.lit(1.0) if neutral is None else F.when(neutral, 0.5).otherwise(1.0)
    y = F.lit(0.0) if neutral is None else F.when(neutral, 0.5).otherwise(0.0)
    of = lambda side, e: parameters.select(F.col("model").alias(model), F.col("entity").alias(e), F.col("attack").alias(f"{side}_a"), F.col("defence").alias(f"{side}_d"))
    c = contests.join(levels.select(F.col("model").alias(model), "level", "edge"), model, "left").join(of("l", left), [model, left], "left").join(of("r", right), [model, right], "left")
    a = lambda s: F.coalesce(f"{s}_a", "level")
    d = lambda s: F.coalesce(f"{s}_d", F.lit(0.0))
    c = c.withColumn("left_rate", F.exp(a("l") - d("r") + x * F.col("edge"))).withColumn("right_rate", F.exp(a("r") - d("l") + y * F.col("edge")))
    return c.drop("level", "edge", "l_a", "l_d", "r_a", "r_d")
