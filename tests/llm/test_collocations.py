"""op13: the query against SQL, and the operator against a plain count on made texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tests.compare import check
from tidemark.llm import collocations as co
from tidemark.llm.catalog import ORACLES, QUERIES


def test_query_matches_sql(spark, sf, duck):
    check(QUERIES["op13_stream_collocations"](spark, sf), duck.sql(ORACLES["op13_stream_collocations"]))


def plain(rows, longest, least, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    dropped = set()
    for (lang, g), a in often.items():
        for i in range(len(g)):
            for j in range(i + 2, len(g) + 1):
                if (j - i) < len(g) and 100 * a >= share * f[lang, g[i:j]]:
                    dropped.add((lang, g[i:j]))
    out = {}
    for (lang, g), a in often.items():
        if (lang, g) not in dropped:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score))
    return sorted((lang, r + 1, p.decode(), *rest) for lang, got in out.items() for r, (_, _, p, *rest) in enumerate(sorted(got)[:top]))


def mined(df, longest=5, least=3, share=100, top=50, **sizes):
    found = co.best(co.mine(df, longest, least, share, **sizes), top)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "A", "aa", "ab", "é", "𝄞", "a\x01", "a\x00b", "\x08", "zu", "c-d", "long" * 20, "a'b"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; \r", "?!", " \x0b"]
    return [(rng.choice(["en", "de", None, "", "a\tb", "x\ny"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"coded": 4}, {"range_bytes": 200, "coded": 2}, {"range_bytes": 100}])
def test_against_plain_counts(spark, sizes):
    rows = made(3)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(df, **sizes) == plain(rows, 5, 3, 100, 50)


def test_other_settings(spark):
    rows = made(4, 40)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert mined(df, longest=3, least=2, share=60, top=7) == plain(rows, 3, 2, 60, 7)


def test_parts_of_a_long_text(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice(["x", "yy", "zzz"]) + rng.choice([" ", "  ", "\t", ". "]) for _ in range(400))
    table = co.Table([b"x", b"zzz"], False)

    def counted(together):
        out = Counter()
        for row, raw, at, upto in co._parts(pa.array([text.encode()], pa.binary()), 5, together):
            for k in co.windows(raw, at, pa.array([b"en"], pa.binary()), 5, table, upto).to_pylist():
                runs = co._Runs(5, 1)
                runs.add(pa.array([k], pa.binary()))
                held, _, counts = runs.close()
                out[table.phrase(held[-1])] += counts[-1]
        return out

    assert counted(7) == counted(64) == counted(1 << 20)


def test_hot_phrase(spark):
    rows = [("en", "same old song and dance again ") for _ in range(300)] + [("en", f"w{k} same old hat") for k in range(200)]
    assert mined(spark.createDataFrame(rows, "lang string, text string").repartition(20), least=100) == plain(rows, 5, 100, 100, 50)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.select("lang", "text").collect()]
    assert mined(odd_docs, least=2) == plain(rows, 5, 2, 100, 50)
    assert mined(no_docs) == []
    assert mined(odd_docs.where("text is null")) == []


def test_exact_beyond_64_bits(spark):
    """Scores come from decimals: products over 2^63 do not wrap."""
    big = spark.sql("select cast(3e9 as bigint) as f, cast(9e12 as bigint) as n, array(cast(4e9 as bigint)) as lefts, array(cast(5e9 as bigint)) as rights")
    row = big.selectExpr("transform(lefts, (l, i) -> (cast(1000 as decimal(38, 0)) * f * n) div (cast(l as decimal(38, 0)) * rights[i])) as s").first()
    assert row.s == [1000 * 3_000_000_000 * 9_000_000_000_000 // (4_000_000_000 * 5_000_000_000)]
