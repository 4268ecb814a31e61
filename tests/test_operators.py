from __future__ import annotations

import datetime as dt
import math
import random
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import grids, scores
from tidemark.operators import cleaning, fits, guards, prices, resampling, tables
from tidemark.operators.asof import as_of, as_of_window, last_state, nearest
from tidemark.plans.guard_plans import metrics_by_name
from tidemark.plans.more_plans import form_features, perturbation_audit
from tidemark.sources import files
from tidemark.sources.tables import contests, entity_rows
from tidemark.streaming import jobs


def one(df):
    return df.first()[0]


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_as_of_takes_last_known_and_keeps_unknown(spark):
    asks = spark.createDataFrame([(1, "a", ts("2024-01-02")), (2, "a", ts("2024-01-01")), (3, "b", ts("2024-01-05")), (4, None, ts("2024-01-05"))], "q int, k string, at timestamp")
    facts = spark.createDataFrame([("a", ts("2024-01-02"), 7), ("a", ts("2024-01-03"), 8), (None, ts("2024-01-01"), 9)], "k string, known timestamp, v int")
    got = {r.q: r.v for r in as_of(asks, facts, ["k"], "at", "known", ["v"]).collect()}
    assert got == {1: 7, 2: None, 3: None, 4: None}
    strict = {r.q: r.v for r in as_of(asks, facts, ["k"], "at", "known", ["v"], strict=True).collect()}
    assert strict[1] is None


def test_as_of_never_sees_later_facts(spark):
    """A broken join that takes the latest fact whatever its time must differ here."""
    asks = spark.createDataFrame([(i, i % 3, ts(f"2024-01-{1 + i:02d}")) for i in range(20)], "q int, k int, at timestamp")
    facts = spark.createDataFrame([(i % 3, ts(f"2024-01-{2 + i:02d}"), i) for i in range(20)], "k int, known timestamp, v int")
    rows = as_of(asks, facts, ["k"], "at", "known", ["v"]).collect()
    assert all(r.known is None or r.known <= r.at for r in rows)
    assert any(r.v is not None and r.v < 17 for r in rows)


def test_last_state_breaks_ties(spark):
    s = spark.createDataFrame([("a", ts("2024-01-01"), 1), ("a", ts("2024-01-01"), 2)], "k string, t timestamp, id int")
    assert [r.id for r in last_state(s, ["k"], "t", ["id"]).collect()] == [2]


def test_as_of_window_counts_both_ends(spark):
    asks = spark.createDataFrame([(1, "a", ts("2024-01-08"))], "q int, k string, at timestamp")
    facts = spark.createDataFrame([("a", ts("2024-01-01"), 1), ("a", ts("2024-01-08"), 2), ("a", ts("2023-12-31"), 3)], "k string, known timestamp, v int")
    assert as_of_window(asks, facts, ["k"], "at", "known", 7 * 86400, {"s": (F.sum, "v")}).first().s == 3


def test_nearest_prefers_the_same_day(spark):
    a = spark.createDataFrame([(1, "x", dt.date(2024, 1, 10))], "q int, k string, d date")
    f = spark.createDataFrame([("x", dt.date(2024, 1, 9), 1), ("x", dt.date(2024, 1, 10), 2), ("x", dt.date(2024, 1, 20), 3)], "k string, fd date, f int")
    assert nearest(a, f, ["k"], "d", "fd", 3, "f").first().f == 2
    assert nearest(a.withColumn("d", F.lit("2024-01-15").cast("date")), f, ["k"], "d", "fd", 3, "f").count() == 0


def test_local_time_gap_and_fold(spark):
    rows = spark.createDataFrame([(ts("2024-03-31 02:30:00"),), (ts("2024-10-27 02:30:00"),), (ts("2024-06-01 12:00:00"),)], "wall timestamp")
    at, reason = cleaning.local_to_utc(F.col("wall"), F.lit("Europe/Berlin"))
    got = [(r.reason, r.at) for r in rows.select(at.alias("at"), reason.alias("reason")).collect()]
    assert [g[0] for g in got] == ["gap", "fold", None]
    assert got[2][1] == ts("2024-06-01 10:00:00")


def test_names_and_numbers(spark):
    n, why = cleaning.whole_number(F.col("t"))
    rows = spark.createDataFrame([("3",), ("",), (None,), ("1.5",), ("-1",), ("x",)], "t string").select(n.alias("n"), why.alias("w")).collect()
    assert [(r.n, r.w) for r in rows] == [(3, None), (None, None), (None, None), (None, "not_a_count"), (None, "not_a_count"), (None, "not_a_number")]
    assert one(spark.range(1).select(cleaning.normal_name(F.lit(" Élan-Vital  F.C. ")))) == "elan vital f c"


def test_margins_sum_to_one_and_keep_order(spark):
    df = spark.createDataFrame([([1.8, 3.6, 4.5],), ([2.2, 3.5, 4.0],)], "p array<double>")
    for method in ("normalization", "power", "shin"):
        for r in df.select("p", prices.remove_margin(F.col("p"), method).alias("q")).collect():
            assert math.isclose(sum(r.q), 1, abs_tol=1e-9)
            assert sorted(r.q, reverse=True) == r.q
    with pytest.raises(ValueError):
        prices.remove_margin(F.col("p"), "none")


def test_grid_mass_and_known_poisson(spark):
    pmf = one(spark.range(1).select(grids.poisson_pmf(F.lit(1.5), 8)))
    assert math.isclose(pmf[2], math.exp(-1.5) * 1.5**2 / 2, rel_tol=1e-12) and math.isclose(sum(pmf), 1, abs_tol=1e-12)
    nb = one(spark.range(1).select(grids.negative_binomial_pmf(F.lit(1.5), F.lit(4.0), 8)))
    assert math.isclose(sum(nb), 1, abs_tol=1e-12) and nb[0] > pmf[0]
    g = spark.range(1).select(grids.score_grid(grids.poisson_pmf(F.lit(1.5), 8), grids.poisson_pmf(F.lit(1.1), 8)).alias("g"))
    m = g.select(grids.markets(F.col("g")).alias("m")).select("m.*").first()
    assert math.isclose(m.p_left + m.p_draw + m.p_right, 1, abs_tol=1e-9)


def test_scores_known_values(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2], 0), ([0.4, 0.4, 0.2], 1)], "p array<double>, y int")
    got = df.select(*[scores.metric(n, F.col("p"), F.col("y")).alias(n) for n in scores.METRICS]).collect()
    assert math.isclose(got[0].log_loss, -math.log(0.5)) and math.isclose(got[0].brier, 0.25 + 0.09 + 0.04) and math.isclose(got[0].rps, (0.25 + 0.04) / 2)
    assert got[1].accuracy == 0.5
    with pytest.raises(ValueError):
        scores.metric("none", F.col("p"), F.col("y"))


def test_ledger_is_immutable(spark):
    held = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c"), (3, "d"), (3, "e")], "k int, v string")
    got = sorted((r.k, r.v, r.status) for r in tables.ledger(held, new, "k", ["v"]).collect())
    assert got[:2] == [(1, "a", "UNCHANGED"), (1, "b", "CONFLICT")]
    assert sorted(s for k, _, s in got if k == 2) == ["UNCHANGED", "WRITTEN"]
    assert sorted(s for k, _, s in got if k == 3) == ["CONFLICT", "WRITTEN"]


def test_table_hash_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, v string")
    assert tables.table_hash(a) == tables.table_hash(a.orderBy(F.col("k").desc()).repartition(3))
    assert tables.table_hash(a) != tables.table_hash(a.withColumn("v", F.when(F.col("k") == 7, "x").otherwise(F.col("v"))))


def test_bootstrap_covers_the_mean_and_is_reproducible(spark):
    rows = spark.range(400).select((F.col("id") % 20).alias("b"), ((F.col("id") * 7919) % 13).cast("double").alias("x"))
    a, b = (resampling.block_bootstrap(rows, "b", ["x"], draws=200, seed=3).first() for _ in range(2))
    assert a == b and a.low <= a["mean"] <= a.high
    mean = resampling.poisson_bootstrap(rows, "x", draws=50).agg(F.avg("mean")).first()[0]
    assert abs(mean - a["mean"]) < 0.5


def test_rates_recover_levels_and_balance(spark):
    rows = spark.range(600).select((F.col("id") % 10).alias("l"), ((F.col("id") + 1 + F.col("id") % 7) % 10).alias("r"), (F.col("id") % 4).alias("a"), (F.col("id") % 3).alias("b")).where("l <> r")
    home, away, p = fits.rates(rows, "l", "r", "a", "b", sweeps=6, shrink=0.0)
    j = rows.join(p.select(F.col("entity").alias("l"), F.col("attack").alias("al")), "l").join(p.select(F.col("entity").alias("r"), F.col("defence").alias("dr")), "r")
    assert j.count() == rows.count() and p.count() == 10
    assert abs(home - rows.agg(F.avg("a")).first()[0]) < 1e-9


def test_logistic_gradient_vanishes(spark):
    rows = spark.range(500).select((F.col("id") % 9 / 4.0).alias("x"), (((F.col("id") * 31) % 17) < (F.col("id") % 9) * 2).cast("int").alias("y"))
    a, b = fits.logistic(rows, [F.col("x")], F.col("y"))
    g = rows.select(F.sum(F.col("y") - 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x")))))).first()[0]
    assert abs(g) < 1e-3 and b > 0


def test_elo_is_ordered_by_pool(spark):
    rows = spark.createDataFrame([("p", 1, 1, 10, 20, 0), ("p", 2, 2, 20, 10, 2), ("q", 1, 3, 10, 20, 1)], "pool string, at int, id int, l int, r int, y int")
    rows = rows.withColumn("known", F.col("at"))
    got = {r.id: (r.left_rating, r.right_rating) for r in fits.elo(rows, "pool", "at", "known", "id", "l", "r", "y").collect()}
    assert got[1] == (1500.0, 1500.0) and got[3] == (1500.0, 1500.0)
    assert got[2][0] < 1500 < got[2][1]


def test_files_report_manifest_and_versions(spark):
    root = tempfile.mkdtemp(prefix="files-")
    put = lambda n, b: open(f"{root}/{n}", "wb").write(b)
    put("ok.csv", b"a,b\n1,2\n3,4\n")
    put("latin.csv", "a,b\né,2\n".encode("latin-1"))
    put("empty.csv", b"\n")
    put("page.csv", b"<html></html>")
    put("short.csv", b"a,b\n1\n")
    put("long.csv", b"a,b\n1,2,3\n")
    put("head.csv", b"a,b\n")
    put("cols.csv", b"a,c\n1,2\n")
    t = files.texts(spark, root)
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in files.file_report(t, ["a", "b"]).collect()}
    assert why == {"ok.csv": None, "latin.csv": None, "empty.csv": "empty", "page.csv": "html_page", "short.csv": "truncated_row", "long.csv": "malformed_row", "head.csv": "header_only", "cols.csv": "missing_columns"}
    assert {r.a for r in files.csv_rows(t.where(F.col("path").endswith("latin.csv")), ["a", "z"]).collect()} == {"é"}
    expected = spark.createDataFrame([("ok.csv", "0"), ("gone.csv", "1")], "name string, sha256 string")
    status = {r.name: r.status for r in files.manifest(files.file_report(t, ["a"]), expected).collect()}
    assert status["ok.csv"] == "CHANGED" and status["gone.csv"] == "MISSING" and status["head.csv"] == "UNEXPECTED"
    out = f"file://{tempfile.mkdtemp(prefix='versions-')}"
    df = spark.range(5)
    files.publish_version(df, out, "1")
    files.publish_version(df, out, "1")
    with pytest.raises(ValueError):
        files.publish_version(spark.range(6), out, "1")
    assert files.current(spark, out).count() == 5
    shutil.rmtree(root)


def test_stream_ledger_replays_nothing(spark):
    out = f"file://{tempfile.mkdtemp(prefix='ledger-')}"
    sink = jobs.ledger_sink(spark, out, "k", ["v"])
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.createDataFrame([(1, "z"), (3, "c")], "k int, v string"), 1)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/ledger").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert spark.read.schema("k int, v string").parquet(f"{out}/conflicts/batch=1").collect()[0].v == "z"


def test_tolerant_compare(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.2), (3, 3.0)], "k int, v double")
    got = {r.k: r.status for r in tables.tolerant_compare(a, b, ["k"], ["v"], 0.1).collect()}
    assert got == {1: "differs", 2: "removed", 3: "added"}


def test_ratings_use_only_known_results(spark):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(k, "ab"[k % 2], start + dt.timedelta(hours=rng.randrange(60)), rng.randrange(6), 6 + rng.randrange(6), rng.randrange(3)) for k in range(150)]
    df = spark.createDataFrame(rows, "contest_id long, pool string, event_ts timestamp, left_id long, right_id long, y int").withColumn("available_at", F.expr("event_ts + interval 3 hours"))
    got = {r.contest_id: (r.left_rating, r.right_rating) for r in fits.elo(df, "pool", "event_ts", "available_at", "contest_id", "left_id", "right_id", "y").collect()}
    moves = {}
    for k, pool, at, i, j, y in sorted(rows, key=lambda r: (r[2], r[0])):
        rating = lambda e: 1500 + sum(m if e == a else -m for n, (p, t, a, b, m) in moves.items() if p == pool and t <= at and e in (a, b))  # noqa: B023, E731
        u, v = rating(i), rating(j)
        assert abs(got[k][0] - u) < 1e-9 and abs(got[k][1] - v) < 1e-9
        moves[k] = (pool, at + dt.timedelta(hours=3), i, j, 20 * ((1, 0.5, 0)[y] - 1 / (1 + 10 ** (-(u + 60 - v) / 400))))
    assert len(got) == 150


def test_guards_raise(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, season int")
    read = lambda seasons, mode: guards.read_seasons(rows, "season", rows.select("season").where(F.col("season").isin(seasons)), mode, F.lit(20), F.lit(30)).count()
    assert read([10], "train") == 1 and read([10, 20], "validate") == 2 and read([10, 20, 30], "final") == 3
    for seasons, mode in (([20], "train"), ([30], "validate"), ([30], "train")):
        with pytest.raises(guards.LockedDataError):
            read(seasons, mode)
    stamp = spark.createDataFrame([("v1", "f1")], "data_version string, feature_version string")
    assert guards.read_versioned(rows, stamp, {"data_version": F.lit("v1"), "feature_version": F.lit("f1")}).count() == 3
    for s, want in ((stamp, "f2"), (stamp.limit(0), "f1"), (stamp.union(stamp), "f1")):
        with pytest.raises(Exception, match="stale table"):
            guards.read_versioned(rows, s, {"data_version": F.lit("v1"), "feature_version": F.lit(want)}).collect()


def test_overlaps_with_more_than_the_longest_alias(spark):
    d = dt.date
    rows = [("s", "X", 1, d(1990, 1, 1), d(2000, 1, 1)), ("s", "X", 2, d(1991, 1, 1), d(1995, 1, 1)), ("s", "x", 1, d(1992, 1, 1), None), ("s", "Y", 1, d(1990, 1, 1), d(1991, 1, 1)), ("s", "Y", 2, d(1992, 1, 1), None)]
    a = spark.createDataFrame(rows, "source string, raw_name string, target int, valid_from date, valid_to date")
    assert sorted((r.target, r.other) for r in cleaning.overlapping_aliases(a).collect()) == [(1, 2), (2, 1)]


def test_names_one_letter_apart(spark):
    names = ["abc", "abd", "ab", "abcd", "xbc", "", "a", "bac", "abcde"]
    got = {(r.name, r.other) for r in cleaning.names_alike(spark.createDataFrame([(1, n) for n in names], "block int, name string"), "block", "name").collect()}
    pairs = [("abc", "abd"), ("abc", "ab"), ("abd", "ab"), ("abc", "abcd"), ("abd", "abcd"), ("abc", "xbc"), ("", "a"), ("a", "ab"), ("abcd", "abcde")]
    assert got == {(n, n) for n in names} | {p for a, b in pairs for p in ((a, b), (b, a))}


def test_the_leak_audit_finds_a_planted_leak(spark, sf):
    rows = entity_rows(contests(spark, sf))

    def leaky(facts, asks):  # takes the last result by the time of the event, known or not
        early = facts.withColumn("available_at", F.col("event_ts") - F.expr("interval 6 hours"))
        return form_features(early, asks)

    at = F.expr("timestamp '2024-01-15'")
    assert perturbation_audit(rows, at).count() == 0 and perturbation_audit(rows, at, leaky).count() > 0


def test_unknown_metrics_are_refused(spark, sf):
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics_by_name(spark.range(1), ["log_loss", "luck"], [])
