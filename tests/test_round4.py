"""Suggestions are found over what deletions leave, few edits first: the same rows as all pairs give, for less work."""

from __future__ import annotations

import random
from itertools import product

import pytest

from tests.test_deep import distance
from tidemark.operators import suggest


def words(rng, parts, k, least, most):
    found = set()
    while len(found) < k:
        w = "".join(rng.choices(parts, k=rng.randint(1, most)))
        if len(w) >= least:
            found.add(w)
    return sorted(found)


def best_of(names, known, least, most):
    rows = set()
    for a in set(names) - set(known) - {""}:
        near = ((1 - distance(a, b) / max(len(a), len(b)), b) for b in known)
        best = sorted((-s, b) for s, b in near if s >= least - 1e-12)[:most]
        rows |= {(a, b, round(-s, 9), k) for k, (s, b) in enumerate(best, 1)}
    return rows


@pytest.mark.parametrize("least, most, slots, task", [(0.55, 2, 27, 100_000), (0.75, 3, 7, 300), (0.75, 1, 12, 1000), (0.9, 3, 27, 500), (1.0, 3, 27, 100_000)])
def test_best_names_are_those_of_all_pairs(spark, monkeypatch, least, most, slots, task):
    """All lengths that rests, segments and bigrams share out, with any table and any tasks."""
    monkeypatch.setattr(suggest, "SLOTS", slots)
    monkeypatch.setattr(suggest, "TASK", task)
    rng = random.Random(11)
    known = words(rng, ["a", "b", "er", "ti", "ü", "𝔸"], 260, 1, 8) + words(rng, ["er", "ti", "on", "sch"], 60, 12, 12)
    names = {""} | set(known[::9])
    for w in rng.sample(known, 120):
        w = list(w)
        for _ in range(rng.randint(1, 4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[at : at + (kind > 0)] = [rng.choice("abertz")] if kind < 2 else []
        names.add("".join(w))
    left, right = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([(k,) for k in known] + [(None,), ("",)], "other string")
    found = {(r.name, r.other, round(r.similarity, 9), r.rank) for r in suggest.suggestions(left, right, "name", "other", least, most).collect()}
    assert found == best_of(names, known, least, most) and (found or least == 1)


def test_names_that_have_their_best_are_not_asked_again(spark, monkeypatch):
    """Names with three partners at one edit meet none at two, so fewer pairs are written than are similar; at two edits only names are asked that lack some."""
    held, write = {}, suggest.written

    def counted(df, name):
        out = write(df, name)
        held.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(suggest, "written", counted)
    every = ["".join(x) for x in product("ab", repeat=8)]
    random.Random(4).shuffle(every)
    known, names = every[:150], every[150:]
    left, right = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "other string")
    found = {(r.name, r.other, round(r.similarity, 9), r.rank) for r in suggest.suggestions(left, right, "name", "other", 0.75, 3).collect()}
    wanted = best_of(names, known, 0.75, 3)
    similar = sum(distance(a, b) <= max(len(a), len(b)) // 4 for a in names for b in known)
    at_one = {a: sum(distance(a, b) == 1 for b in known) for a in names}
    assert found == wanted
    assert held["names"][1] == sum(n < 3 for n in at_one.values()) < len(names) / 2
    assert sum(held["pairs"]) < similar / 2


def test_rests_meet_few_others(spark):
    """Rests number all that a few deletions leave: a pair meets at them exactly if it has so many edits, or shares as much otherwise."""
    one, two = (spark.createDataFrame([(x,)], "a string") for x in ("banana", "aabb"))
    assert suggest._rests(one, "a", 1, 0.75, 1).count() == 6 + 1  # less each letter, and itself as the shorter one of a pair
    assert suggest._rests(two, "a", 1, 0.75, 1).count() == 2 + 1
    near = spark.createDataFrame([(b,) for b in ("banan", "bananas", "banama", "canama", "bahamas")], "b string")
    assert {r.b for r in suggest.rest_pairs(one, near, 1, 0.75).collect()} == {"banan", "bananas", "banama"}
    assert suggest.rest_pairs(one, near, 3, 0.75) is None


@pytest.mark.parametrize("together, held", [(1, 1), (1, 6), (40, 1 << 20), (8 << 20, 1 << 20)])
def test_words_are_those_of_the_sql(spark, duck, monkeypatch, together, held):
    """Words end with their text, whatever is taken together; the dotted I and the Kelvin sign become ASCII letters, which the dotted I was not before."""
    monkeypatch.setattr(suggest, "TOGETHER", together)
    monkeypatch.setattr(suggest, "HELD", held)
    texts = ["", None, "tiger", "TIGER lion wolves", "abcde", "fghij", "abcd", "ISTANBUL \u0130stanbul D\u0130YARBAKIR", "\u212aelvin \u017ftreet stra\u00dfe", "a@bcdefg[hijklm`nopqr{stuvw~", "z" * 300, "\U0001f600tiger\U0001f600", "  ", None, "one two", "wolves"]
    found = {(r.word, r.n) for r in suggest.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text", 5).collect()}
    rows = duck.execute("select w, count(*) from (select unnest(regexp_extract_all(lower(t), '[a-z]{5,}')) as w from (select unnest(?::varchar[]) as t)) group by 1", [texts]).fetchall()
    assert found == set(rows) and ("istanbul", 2) in found


def test_words_of_no_text(spark):
    for rows in ([], [(None,)], [("",), ("",)], [("one two",)]):
        assert suggest.word_counts(spark.createDataFrame(rows, "text string"), "text", 5).count() == 0
