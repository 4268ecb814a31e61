"""Cleaning with explicit reasons: dates, zones, numbers, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_day(text: Column, formats: tuple[str, ...] = ("dd/MM/yyyy", "dd/MM/yy")) -> Column:
    """The date by the first format that fits, else null. A format only sees texts of its own length. Years of two figures from 69 on are of the last century."""
    clean = F.trim(text)
    days = []
    for f in formats:
        day = F.to_date(F.try_to_timestamp(clean, F.lit(f)))
        if "yyyy" not in f:
            day = F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)
        days.append(F.when(F.length(clean) == len(f), day))
    return F.coalesce(*days)


def local_to_utc(wall: Column, zone: Column) -> tuple[Column, Column]:
    """(instant, reason): a wall time that a zone skips is a gap, one that it has twice a fold, of whatever length; both have no instant.

    The wall time is read with the zone's offsets of a day before and a day after; one reading that comes back is the instant.
    """
    local = lambda t: F.from_utc_timestamp(t, zone)
    day = F.expr("interval 1 day")
    before, after = (wall - (local(t) - t) for t in (wall - day, wall + day))
    early, late = local(before) == wall, local(after) == wall
    reason = F.when(~early & ~late, "gap").when(early & late & (before != after), "fold")
    return F.when(reason.isNull(), F.when(early, before).otherwise(after)), reason


def availability(seen_at: str, event_at: str, lag: Column) -> tuple[Column, Column]:
    """(time, label): when a row was seen to be known, labelled observed, else the event and the lag, labelled inferred."""
    return F.coalesce(F.col(seen_at), F.col(event_at) + lag), F.when(F.col(seen_at).isNotNull(), "observed").otherwise("inferred")


def whole_number(text: Column) -> tuple[Column, Column]:
    """(number, reason): blank is null without a reason; fractions, negatives and words have one."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    value = clean.try_cast("double")
    reason = F.when(clean == "", None).when(value.isNull(), "not_a_number").when((value < 0) | (F.floor(value) != value), "not_a_count")
    return F.when(reason.isNull(), value.cast("long")), reason


def normal_name(text: Column) -> Column:
    """Lower case, marks to blanks, single blanks, Latin accents dropped."""
    plain = F.translate(F.lower(text), "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9 ]", " "), r" +", " "))


def resolve(rows: DataFrame, aliases: DataFrame, name: str, source: str, day: str) -> DataFrame:
    """rows with target: of the aliases of that source and normal name valid on the day, the one with the highest confidence (ties: the smaller target)."""
    r = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__norm", normal_name(F.col(name)))
    a = aliases.select(F.col("source").alias("__s"), normal_name(F.col("raw_name")).alias("__norm"), "target", "valid_from", "valid_to", "confidence")
    valid = F.col(day).between(F.col("valid_from"), F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    joined = r.join(a, (r["__norm"] == a["__norm"]) & (r[source] == a["__s"]) & valid, "left").drop(a["__norm"])
    best = F.row_number().over(Window.partitionBy("__id").orderBy(F.col("confidence").desc(), "target"))
    return joined.withColumn("__n", best).where("__n = 1").drop("__n", "__id", "__norm", "__s", "valid_from", "valid_to", "confidence")


def overlapping_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases of one source and name whose intervals overlap an earlier one with another target; `other` is the target of the latest end.

    Each row is copied for each of the name's targets, few, and a running maximum of the ends leaves that target out; no pairs of rows.
    """
    a = aliases.withColumn("norm", normal_name(F.col("raw_name"))).withColumn("end", F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).select("source", "norm", "target", "valid_from", "end")
    several = a.groupBy("source", "norm").agg(F.collect_set("target").alias("targets")).where(F.size("targets") > 1)
    copies = a.join(several, ["source", "norm"]).withColumn("but", F.explode("targets"))
    w = Window.partitionBy("source", "norm", "but").orderBy("valid_from", "target").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("target") != F.col("but"), F.struct("end", "target"))).over(w)
    found = copies.withColumn("before", before).where((F.col("target") == F.col("but")) & (F.col("before.end") >= F.col("valid_from")))
    return found.select("source", "norm", "target", F.col("before.target").alias("other"))


def names_alike(names: DataFrame, block: str, name: str) -> DataFrame:
    """(block, name, other) for distinct names of a block at most one letter apart, both ways, and each name with itself.

    Two names one letter apart have a form in common: a name itself or without one letter. So they meet by equality and are then verified.
    """
    cut = lambda i: F.concat(F.substring(F.col(name), F.lit(1), i - 1), F.substring(F.col(name), i + 1, F.length(name)))
    forms = F.array_distinct(F.concat(F.array(name), F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), cut)).otherwise(F.array().cast("array<string>"))))
    keyed = names.select(block, name, F.explode(forms).alias("__form"))
    met = keyed.join(keyed.select(block, "__form", F.col(name).alias("other")), [block, "__form"]).select(block, name, "other").distinct()
    return met.where(F.levenshtein(name, "other") <= 1)
