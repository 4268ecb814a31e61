"""Faults that show on large tables only, each on the smallest table that shows it."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog


@pytest.fixture(scope="session")
def many_events(spark, tmp_path_factory):
    """A folder with 600,000 events over four weeks."""
    i = F.col("event_id")
    kinds = F.get(F.array(*[F.lit(k) for k in ("view", "click", "purchase")]), (i * 7919 % 3).cast("int"))
    ts = F.timestamp_seconds(1704067200 + F.pmod(i * 1237, F.lit(28 * 24)) * 3600).cast("timestamp_ntz")
    e = spark.range(600_000).select(F.col("id").alias("event_id")).select(i, ts.alias("ts"), (i * 31 % 500).alias("user_id"), kinds.alias("event_type"), (F.pmod(F.xxhash64(i), F.lit(50000)) / 100.0).alias("value"), F.lit("{}").alias("props"))
    path = tmp_path_factory.mktemp("many")
    e.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_prior_weights_adds_counts_not_rows(spark, many_events):
    """Sums of equal losses, row by row, drift in the last digits with the number of rows; weighted counts do not."""
    from tidemark.sources.tables import contests, forecasts

    f = forecasts(contests(spark, many_events)).withColumn("origin", F.date_format("season", "yyyy-MM-dd"))
    first = {r[0]: r[1] for r in f.groupBy("origin").agg(F.min("event_ts")).collect()}
    rows = f.groupBy("origin", "pool", "y", F.col("available_at").alias("known")).count().collect()
    own = Counter()
    for r in rows:
        own[r.origin, r.pool, r.y] += r["count"]
    for got in catalog.QUERIES["prior_weights"](spark, many_events).collect():
        known = Counter()
        for r in rows:
            if r.known <= first[got.origin]:
                known[r.pool, r.y] += r["count"]
        total, parts, n = sum(known.values()), [], 0
        for (origin, pool, y), k in own.items():
            if origin == got.origin and (held := sum(v for (p, _), v in known.items() if p == pool)):
                share = (known[pool, y] + got.weight * sum(v for (_, z), v in known.items() if z == y) / total) / (held + got.weight)
                parts.append(-k * math.log(max(share, 1e-15)))
                n += k
        assert got.n == n and math.isclose(got.loss, math.fsum(parts) / n, rel_tol=5e-15)


def test_logits_write_equal_rows_once(spark, monkeypatch):
    """Steps run over distinct rows: twenty times the rows make no more of them, and the fit is that of single rows."""
    from tidemark.operators import softmax

    held = {}
    write = softmax.written

    def counted(df, name):
        out = write(df, name)
        held.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(softmax, "written", counted)
    i = F.col("id")
    rows = spark.range(4000).select(F.lit("k").alias("k"), (i % 3).cast("int").alias("y"), F.array(0.2 + 0.01 * (i % 10), F.lit(0.3), 0.5 - 0.01 * (i % 10)).alias("p"))
    features, start = softmax.temperature(F.col("p"))
    found = softmax.fit(rows, ["k"], F.col("y"), features, start, 1.0, steps=4).first()
    counts = rows.groupBy("k", "y", "p").agg(F.count("*").alias("c"))
    again = softmax.fit(counts, ["k"], F.col("y"), features, start, 1.0, steps=4, weight=F.col("c")).first()
    assert found.n == again.n == 4000 and found.theta == pytest.approx(again.theta, abs=1e-12)
    assert held["softmax-rows"] == [30, 30]


def test_names_meet_few_others(spark):
    """Only similar pairs leave the join, and none of them is lost, long names included."""
    import random

    from tidemark.operators import suggest

    rng = random.Random(5)
    known = sorted({"".join(rng.choices("abcdefgh", k=rng.randint(1, 14))) for _ in range(700)} | {"".join(rng.choices("abc", k=k)) for k in (30, 33, 40)})
    names = set()
    for w in rng.sample(known, 150) + known[-3:] + [x for x in known if len(x) >= 30]:
        w = list(w)
        for _ in range(rng.randint(1, 1 + len(w) // 4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (kind > 0)] = [rng.choice("abcdefgh")] if kind < 2 else []
        names.add("".join(w))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    left, right = spark.createDataFrame([(n,) for n in names], "a string"), spark.createDataFrame([(k,) for k in known], "b string")
    for least in (0.55, 0.75):
        wanted = {(a, b) for a in names for b in known if a and 1 - edits(a, b) / max(len(a), len(b)) >= least - 1e-12}
        assert {(r.a, r.b) for r in suggest.similar_names(left, right, "a", "b", least).collect()} == wanted
    assert suggest.segment_pairs(left, right, 0.75).count() <= len(wanted) < suggest.bigram_pairs(left, right, 0.75).count() / 12  # what met before


def test_price_tasks_grow_in_number_not_in_size(spark, sf, duck, monkeypatch):
    """Prices are numbered in tasks of a bounded number of rows, and give the same triples."""
    from tests.compare import check
    from tidemark.sources import tables

    monkeypatch.setattr(tables, "QUOTE_ROWS", 100)
    rows = tables.read_table(spark, sf, "lineitem").count()
    q = tables.quotes(spark, sf)
    assert q.rdd.getNumPartitions() == rows // 100
    check(catalog.QUERIES["fair_prices"](spark, sf), duck.sql(catalog.ORACLES["fair_prices"]))
