"""Guards on what may be read, and plug-ins whose results are checked before anybody uses them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class LockedDataError(ValueError):
    """Rows were asked for that this reader may not see."""


def season_verdict(season: Column, mode: Column, train_until: Column, test_from: Column) -> Column:
    """allowed, locked (test seasons outside the final mode) or outside (validation seasons in training) for a season read in a mode: train, validate or final."""
    locked = (season >= test_from) & (mode != "final")
    outside = (season >= train_until) & (mode == "train")
    return F.when(locked, "locked").when(outside, "outside").otherwise("allowed")


def read_seasons(rows: DataFrame, season: str, wanted: DataFrame, mode: str, train_until: Column, test_from: Column) -> DataFrame:
    """The rows of the wanted seasons; raises before any row is read if the mode may not see one of them. wanted: one row a season."""
    refused = wanted.where(season_verdict(F.col(season), F.lit(mode), train_until, test_from) != "allowed").select(season).orderBy(season).limit(5).collect()
    if refused:
        raise LockedDataError(f"mode {mode} may not read {[str(r[0]) for r in refused]}")
    return rows.join(wanted, season, "left_semi")


def consume(log: DataFrame, requests: DataFrame, purpose: str, at: str, key: str, registered: str) -> DataFrame:
    """requests with status: CONSUMED for the first registered one of a purpose that the log (purpose) does not hold yet, else the reason of the refusal."""
    w = Window.partitionBy(purpose, F.col(registered).isNotNull()).orderBy(at, key)
    held = log.select(F.col(purpose), F.lit(True).alias("__held")).distinct()
    nth = requests.withColumn("__n", F.row_number().over(w)).join(held, purpose, "left")
    status = F.when(F.col(registered).isNull(), "REFUSED_NOT_REGISTERED").when(F.col("__held") | (F.col("__n") > 1), "REFUSED_CONSUMED").otherwise("CONSUMED")
    return nth.withColumn("status", status).drop("__n", "__held")


def version_problems(expected: dict[str, Column]) -> Column:
    """Names of the stamps of a table, in order and comma-joined, that are not as expected; empty for a fresh one. A null is a problem."""
    return F.concat_ws(",", *[F.when(F.coalesce(F.col(c) == v, F.lit(False)), None).otherwise(F.lit(c)) for c, v in expected.items()])


def read_versioned(rows: DataFrame, stamp: DataFrame, expected: dict[str, Column]) -> DataFrame:
    """rows, if the one row of their stamp is as expected; else reading them raises, and so does a stamp that is absent or not alone."""
    problems = F.when(F.count("*") != 1, F.lit("stamp")).otherwise(F.first(version_problems(expected)))
    checked = stamp.agg(problems.alias("__problems"))
    fresh = F.when(F.col("__problems") == "", True).otherwise(F.raise_error(F.concat(F.lit("stale table: "), F.col("__problems"))).cast("boolean"))
    return rows.join(F.broadcast(checked), F.lit(True)).where(fresh).drop("__problems")


def vector_status(p: list[str], tolerance: float = 1e-9) -> Column:
    """predicted for a vector of shares that add up to one, abstained for one of nulls, error for any other."""
    cols = [F.col(c) for c in p]
    none, some = reduce(Column.__and__, [c.isNull() for c in cols]), reduce(Column.__or__, [c.isNull() for c in cols])
    inside = reduce(Column.__and__, [c.between(0, 1) for c in cols])
    whole = inside & (F.abs(sum(cols[1:], cols[0]) - 1) <= tolerance)
    return F.when(none, "abstained").when(~some & F.coalesce(whole, F.lit(False)), "predicted").otherwise("error")


def predict_all(frame: DataFrame, keys: list[str], plugins: dict[str, Callable[[], Sequence[Column]]]) -> DataFrame:
    """keys, model, p0, p1, p2 and status of every plug-in, which gives a vector of columns of the frame. Vectors that are no shares are errors and come as nulls; no plug-in fills in for another.

    All plug-ins read one pass over the frame, so it is made once and not once a plug-in.
    """
    given = [F.struct(F.lit(name).alias("model"), *[c.cast("double").alias(f"p{k}") for k, c in enumerate(predict())]) for name, predict in plugins.items()]
    rows = frame.select(*keys, F.explode(F.array(*given)).alias("__v")).select(*keys, "__v.*").withColumn("status", vector_status(["p0", "p1", "p2"]))
    return rows.withColumns({c: F.when(F.col("status") == "predicted", F.col(c)) for c in ("p0", "p1", "p2")})
