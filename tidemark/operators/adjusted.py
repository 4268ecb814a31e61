"""Means by side and means adjusted for the opponent, each from what was known at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, last_state
from tidemark.operators.features import running
from tidemark.storage import written


def overall_as_of(asking: DataFrame, facts: DataFrame, ask_at: str, known_at: str, value: str, strict: bool = False) -> DataFrame:
    """asking with overall_sum and overall_n: sum and number of all facts' non-null values known at (strict: before) its time, whatever their key; 0 where there are none.

    Facts are summed by time, times run within their day, and days before are added as one row a day, so no task holds more than a day's
    distinct times. A row without time gets 0; facts without time count nowhere.
    """
    ask, fact = asking.where(F.col(ask_at).isNotNull()).select(F.col(ask_at).alias("__t")).distinct(), facts.where(F.col(known_at).isNotNull() & F.col(value).isNotNull())
    times = fact.groupBy(F.col(known_at).alias("__t")).agg(F.sum(F.col(value).cast("double")).alias("__s"), F.count("*").alias("__n"))
    both = times.withColumn("__side", F.lit(1 if strict else 0)).unionByName(ask.select("__t", F.lit(0.0).alias("__s"), F.lit(0).cast("long").alias("__n"), F.lit(0 if strict else 1).alias("__side")))
    both = both.withColumn("__day", F.floor(F.unix_seconds("__t") / 86400))
    days = both.groupBy("__day").agg(F.sum("__s").alias("__ds"), F.sum("__n").alias("__dn"))
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    days = days.select("__day", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("__ds", "__dn")])
    within = Window.partitionBy("__day").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select("__day", "__t", "__side", *[F.sum(c).over(within).alias(c) for c in ("__s", "__n")]).where(F.col("__side") == (0 if strict else 1)).join(days, "__day")
    found = run.select("__t", (F.col("__s") + F.col("__ds")).alias("overall_sum"), (F.col("__n") + F.col("__dn")).alias("overall_n"))
    out = asking.join(found, asking[ask_at] == F.col("__t"), "left").drop("__t")
    return out.withColumns({"overall_sum": F.coalesce("overall_sum", F.lit(0.0)), "overall_n": F.coalesce("overall_n", F.lit(0).cast("long"))})


def _settled(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("own_n").isNotNull() & F.col("opp_n").isNotNull() & F.col("available_at").isNotNull())


def _state(rows: DataFrame, keys: list[str], values: dict) -> DataFrame:
    return last_state(running(rows, keys, ["available_at", "contest_id"], values), keys, "available_at", ["contest_id"]).select(*keys, "available_at", *values)


def side_means(asking: DataFrame, rows: DataFrame, last: int = 10, least: int = 3) -> DataFrame:
    """asking (contest_id, side, entity_id, cutoff) with the entity's means for and against over its `last` rows on the left and on the right known at the cutoff.

    Columns for_left, against_left, for_right, against_right; null with fewer than `least` rows on that side. Rows without both counts are of no use yet. Rows of
    asking that are equal stay separate.
    """
    names = asking.columns
    state = _state(_settled(rows), ["entity_id", "side"], {"mean_for": (F.avg, "own_n", last, least), "mean_against": (F.avg, "opp_n", last, least)}).withColumnRenamed("side", "at_side")
    each = asking.withColumn("ask", F.monotonically_increasing_id()).withColumn("at_side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    found = as_of(each, state, ["entity_id", "at_side"], "cutoff", "available_at", ["mean_for", "mean_against"])
    on = lambda s, c: F.max(F.when(F.col("at_side") == s, F.col(c)))
    means = [on(s, f"mean_{w}").alias(f"{w}_{n}") for s, n in (("L", "left"), ("R", "right")) for w in ("for", "against")]
    return found.groupBy("ask", *names).agg(*means).drop("ask")


def opponent_adjusted(asking: DataFrame, rows: DataFrame, last: int = 10, least: int = 3) -> DataFrame:
    """asking (contest_id, side, entity_id, cutoff) with adjusted: the mean, over the entity's `last` rows, of what it scored less what that opponent concedes on average.

    Both are as known at the cutoff. An opponent with fewer than `least` rows counts with the mean of all rows known then. Null with fewer than `least` rows of its own.
    """
    known = _settled(rows).withColumn("met", F.struct("opp_id", "own_n"))
    state = _state(known, ["entity_id"], {"held": (F.collect_list, "met", last, least), "conceded": (F.avg, "opp_n", None, least)})
    asked = as_of(asking.withColumn("ask", F.monotonically_increasing_id()), state, ["entity_id"], "cutoff", "available_at", ["held"]).drop("available_at")
    asked = written(asked, "asked")  # both sides below go by its numbers; the rows of opponents met carry nothing but these
    each = asked.select("ask", "cutoff", F.explode("held").alias("one")).select("ask", "cutoff", F.col("one.opp_id").alias("met_id"), F.col("one.own_n").alias("scored"))
    rated = as_of(each, state.select(F.col("entity_id").alias("met_id"), "available_at", "conceded"), ["met_id"], "cutoff", "available_at", ["conceded"])
    found = rated.groupBy("ask").agg(F.sum(F.col("scored") - F.coalesce("conceded", F.lit(0.0))).alias("gain"), F.sum(F.col("conceded").isNull().cast("long")).alias("unknown"), F.count("*").alias("met"))
    level = overall_as_of(asked.drop("held"), known, "cutoff", "available_at", "own_n").join(found, "ask", "left")
    gain = F.when(F.col("unknown") > 0, F.col("gain") - F.col("unknown") * F.col("overall_sum") / F.col("overall_n")).otherwise(F.col("gain"))
    return level.select(*asking.columns, (gain / F.col("met")).alias("adjusted"))


def adjusted_form(rows: DataFrame, shrink: float = 5.0, last: int = 10, least: int = 3, prior: float = 1.3) -> DataFrame:
    """entity_id, available_at, adj_att, adj_def: means over the last rows of what the entity scored and conceded, each less the opponent's rate before that contest.

    The rate is the opponent's mean shrunk to the mean of all rows by `shrink` rows; `prior` stands for that mean while nothing is known. Only rows known before
    the contest's own time count in a rate, so contests that become known together never see each other. One row for each entity and time; null with fewer than `least` rows.
    """
    known = _settled(rows)
    state = _state(known, ["entity_id"], {"gf": (F.sum, "own_n", None, 1), "ga": (F.sum, "opp_n", None, 1), "games": (F.count, "contest_id", None, 1)})
    own = known.select("entity_id", "contest_id", F.col("available_at").alias("at"), "opp_id", "own_n", "opp_n")
    rated = as_of(own, state.withColumnRenamed("entity_id", "opp_id"), ["opp_id"], "at", "available_at", ["gf", "ga", "games"], strict=True).drop("available_at")
    level = overall_as_of(rated, known, "at", "available_at", "own_n", strict=True)
    mean = F.when(F.col("overall_n") > 0, F.col("overall_sum") / F.col("overall_n")).otherwise(F.lit(prior))
    rate = lambda c: (F.coalesce(c, F.lit(0)) + shrink * mean) / (F.coalesce("games", F.lit(0)) + shrink)
    moves = level.select("entity_id", "contest_id", F.col("at").alias("available_at"), (F.col("own_n") - rate("ga")).alias("att"), (F.col("opp_n") - rate("gf")).alias("dfn"))
    return _state(moves, ["entity_id"], {"adj_att": (F.avg, "att", last, least), "adj_def": (F.avg, "dfn", last, least)})
