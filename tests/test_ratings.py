"""Ratings by blocks against a plain replay with dictionaries."""

from __future__ import annotations

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits, ratings
from tidemark.plans import rating_plans
from tidemark.plans.catalog import QUERIES


def away(x):
    """Rounded half away from zero, as the engine does."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def plain(rows, rules):
    u = lambda x: away(x * ratings.UNIT)
    rating, season, n, group, seen, offset = {}, {}, defaultdict(int), {}, set(), defaultdict(int)
    waiting, out = [], {}
    for block in sorted({c["block"] for c in rows}):
        for c in [w for w in waiting if w["known"] <= block]:
            rating[c["l"]] += c["move"]
            rating[c["r"]] -= c["move"]
            offset[c["lg"]] += c["shift"]
            offset[c["rg"]] -= c["shift"]
            for e in (c["l"], c["r"]):
                n[e] += 1
                if not c["bridge"]:
                    seen.add(e)
        waiting = [w for w in waiting if w["known"] > block]
        now = [c for c in rows if c["block"] == block]
        sums = defaultdict(list)
        for e in seen:
            sums[group[e]].append(rating[e])
        means = {g: away(sum(v) / len(v)) for g, v in sums.items()}
        enter = defaultdict(list)
        for c in now:
            enter[c["l"]].append((c["lg"], c["season"], c["bridge"]))
            enter[c["r"]].append((c["rg"], c["season"], c["bridge"]))
        begun = bool(seen)
        for e, rows_of in enter.items():
            to = max(s for _, s, _ in rows_of)
            if e not in rating:
                group[e] = min(g for g, _, _ in rows_of)
                rating[e] = means.get(group[e], u(rules.start)) - (u(rules.entry) if begun and not all(b for _, _, b in rows_of) else 0)
                season[e] = to
            elif to > season[e]:
                mean = means.get(group[e], u(rules.start))
                rating[e] = mean + away((1 - rules.reversion) * (rating[e] - mean))
                season[e] = to
        for c in now:
            diff = (rating[c["l"]] - rating[c["r"]] + u(rules.edge) + (offset[c["lg"]] - offset[c["rg"]] if c["bridge"] else 0)) / ratings.UNIT
            expected = 1 / (1 + 10 ** (-diff / 400))
            out[c["contest"]] = (rating[c["l"]] / ratings.UNIT, rating[c["r"]] / ratings.UNIT, diff, expected, min(n[c["l"]], n[c["r"]]))
            if c["y"] is not None:
                size = (1 + math.log1p(abs(c["margin"] or 0)) if rules.margin else 1) * (1 - c["y"] / 2 - expected)
                move = u((rules.bridge_share if c["bridge"] else 1) * rules.k * size)
                waiting.append({**c, "move": move, "shift": u(rules.bridge_k * size) if c["bridge"] and c["lg"] != c["rg"] else 0})
    return out


def same(found, wanted):
    assert set(found) == set(wanted)
    for k, w in wanted.items():
        assert found[k] == pytest.approx(w, rel=1e-12, abs=2e-6), k


def as_dict(df):
    return {r.contest: (r.left_rating, r.right_rating, r.diff, r.expected, r.settled_before) for r in df.collect()}


def test_block_ratings_on_the_table(spark, sf):
    rows = [r.asDict() for r in rating_plans.rated_contests(spark, sf).collect()]
    for r in rows:
        r.update({k: str(r[k]) for k in ("l", "r", "lg", "rg")})
    same(as_dict(QUERIES["block_ratings"](spark, sf)), plain(rows, ratings.Rules()))


def made(spark, rows):
    names = "contest int, block long, known long, l string, r string, lg string, rg string, season string, bridge boolean, y int, margin int"
    return spark.createDataFrame(rows, names), [dict(zip([x.split()[0] for x in names.split(", ")], r)) for r in rows]


def test_unsettled_late_and_odd_rows(spark):
    df, rows = made(spark, [
        (1, 0, 1, "a", "b", "x", "x", "s1", False, 0, 3), (2, 0, 4, "c", "d", "y", "y", "s1", False, 2, 1), (3, 1, 2, "a", "c", "x", "y", "s1", True, 1, 0),
        (4, 2, 3, "a", "e", "x", "x", "s2", False, None, None), (5, 4, 5, "e", "c", "x", "y", "s2", True, 0, None), (6, 9, 10, "b", "d", "x", "y", "s1", True, 2, 2),
        (7, 9, 10, "b", "f", "x", "z", "s2", False, 1, 0),
    ])
    for rules in (ratings.Rules(), ratings.Rules(margin=False, reversion=0.0, entry=0.0, bridge_share=1.0)):
        same(as_dict(ratings.replay(df, {"v": rules})), plain(rows, rules))
    torn = df.unionByName(df.limit(1).withColumn("l", F.lit(None).cast("string")))
    assert ratings.replay(torn, {"v": ratings.Rules()}).count() == len(rows)
    assert ratings.replay(df.limit(0), {"v": ratings.Rules()}).count() == 0


def test_one_start_a_block_equals_a_replay_in_order(spark):
    """With one contest to a block and results known at once, blocks give what a replay in order gives."""
    import random

    rng = random.Random(2)
    pairs = [("a", "b"), ("c", "d"), *(rng.sample("abcd", 2) for _ in range(12))]
    rows = [(k, max(0, k - 1), max(0, k - 1) + 1, l, r, "g", "g", "s", False, rng.randint(0, 2), 1) for k, (l, r) in enumerate(pairs)]
    held, wanted = {}, {}
    for k, _, _, l, r, *_, y, _ in rows:  # noqa: E741
        a, b = held.get(l, 1500.0), held.get(r, 1500.0)
        move = 20 * (1 - y / 2 - 1 / (1 + 10 ** (-(a + 60 - b) / 400)))
        wanted[k] = (a, b)
        held[l], held[r] = a + move, b - move
    df, _ = made(spark, rows)
    found = as_dict(ratings.replay(df, {"v": ratings.Rules(margin=False)}))
    assert all(found[k][:2] == pytest.approx(w, abs=1e-4) for k, w in wanted.items())


def test_tuned_picks_the_best_of_earlier_folds(spark, sf):
    c = rating_plans.rated_contests(spark, sf)
    rows = [r.asDict() for r in c.collect()]
    for r in rows:
        r.update({k: str(r[k]) for k in ("l", "r", "lg", "rg")})
    losses = {}
    for v, rules in rating_plans.VARIANTS.items():
        for k, w in plain(rows, rules).items():
            row = next(r for r in rows if r["contest"] == k)
            s = 1 - row["y"] / 2
            losses.setdefault((v, row["block"]), []).append(-(s * math.log(w[3]) + (1 - s) * math.log(1 - w[3])))
    found = {r.block: r for r in QUERIES["tuned_ratings"](spark, sf).collect()}
    blocks = sorted({b for _, b in losses})
    assert set(found) == set(blocks[1:])
    for b in blocks[1:]:
        inner = {v: [x for (w, f), xs in losses.items() if w == v and f < b for x in xs] for v in rating_plans.VARIANTS}
        best = min(inner, key=lambda v: (round(sum(inner[v]) / len(inner[v]), 12), v))
        assert found[b].variant == best and found[b].inner_n == len(inner[best])
        assert found[b].loss == pytest.approx(sum(losses[best, b]) / len(losses[best, b]), rel=1e-9)


def test_replay_keeps_unsettled_contests(spark):
    rows = [("p", 1, 2, 1, "a", "b", 0), ("p", 3, None, 2, "a", "b", None), ("p", 5, 6, 3, "a", "b", 1)]
    df = spark.createDataFrame(rows, "pool string, at long, known long, id long, l string, r string, y int").selectExpr("pool", "timestamp_seconds(at) at", "timestamp_seconds(known) known", "id", "l", "r", "y")
    found = {r.id: (r.left_rating, r.right_rating) for r in fits.elo(df, "pool", "at", "known", "id", "l", "r", "y").collect()}
    assert set(found) == {1, 2, 3} and found[2] == found[3] and found[2][0] > 1500
