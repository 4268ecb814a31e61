"""Ratings by blocks of time: groups with offsets, seasons, and parameters chosen on inner folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ratings
from tidemark.operators import ridge_rates as ridge
from tidemark.plans.registry import Registry
from tidemark.sources.tables import contests, outcome

query = Registry()
#: Five days to a block, and the groups that entities are dealt to; one pool's contests are those across groups.
LENGTH, GROUPS, BRIDGE = 5 * 86_400, 4, "purchase"
VARIANTS = {f"k{k}-r{int(100 * r):02d}": ratings.Rules(k=k, reversion=r) for k in (10.0, 20.0, 40.0) for r in (0.0, 0.25)}


def rated_contests(spark, sf) -> DataFrame:
    c = contests(spark, sf).withColumn("y", outcome()).withColumn("block", ratings.block_of("event_ts", LENGTH))
    return c.select(
        F.col("contest_id").alias("contest"), "block", ratings.known_block("available_at", "block", LENGTH).alias("known"), F.col("left_id").alias("l"), F.col("right_id").alias("r"),
        (F.col("left_id") % GROUPS).alias("lg"), (F.col("right_id") % GROUPS).alias("rg"), F.date_format("season", "yyyy-MM-dd").alias("season"), (F.col("pool") == BRIDGE).alias("bridge"), "y",
        (F.col("left_n") - F.col("right_n")).alias("margin"),
    )


@query()
def block_ratings(spark, sf):
    """FIT3: ratings with group offsets, entrants below their group's mean and season carry-over; contests of a block never see each other."""
    return ratings.replay(rated_contests(spark, sf), {"default": ratings.Rules()}).drop("variant")


@query()
def tuned_ratings(spark, sf):
    """FIT16: steps and reversions as a table of variants, all in one replay; each fold takes the best of the folds before it."""
    scored = ratings.replay(rated_contests(spark, sf), VARIANTS, ("y",)).select("variant", "block", ratings.loss(F.col("expected"), F.col("y")).alias("loss"))
    return ratings.tuned(scored, "block")


def neutral(c: str = "contest_id"):
    return F.col(c) % 13 == 0


@query()
def ridge_rates(spark, sf):
    """FIT8: attacks and defences of each pool with group terms, edge and neutral venues; penalised likelihood at its minimum."""
    p, levels = ridge.fit(contests(spark, sf), "left_id", "right_id", "left_n", "right_n", F.col("pool"), F.col("entity") % GROUPS, neutral())
    return p.join(levels.select("model", "level", "edge"), "model").select(F.col("model").alias("pool"), "entity", "grp", "attack", "defence", "level", "edge")


@query()
def ridge_levels(spark, sf):
    """FIT6 and FIT8: one model for each pool and season with recent rows weighing more: level, edge, dispersion by moments and the gradient left."""
    c = contests(spark, sf).withColumn("model", F.concat_ws("/", "pool", F.date_format("season", "yyyy-MM-dd")))
    age = F.datediff(F.lit("2024-02-01"), F.to_date("event_ts"))
    _, levels = ridge.fit(c, "left_id", "right_id", "left_n", "right_n", F.col("model"), None, neutral(), F.pow(F.lit(0.5), age / 30))
    return levels
