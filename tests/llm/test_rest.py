from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, gru_lm, secret_trigrams, sharding, toxicity, words
from tidemark.llm.common import table, work_dir


def brute_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


HARD = [
    "secret=token:abcdefgh", "token: a password=hunter22", "PassWord = 'abc.def+ghi'", "api_key:x", "apikey = 1234567", "AKIA AKIAAKIA" + "B" * 20, "x" * 5 + "0" * 30 + "g" + "f" * 23,
    "😀 token=\"abcdef\" 😀 secret : zzzzzz", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "tokeN=KELVIN123", "", None, "password==abcde secret=ab token=abcdef1", "AKIA" + "A" * 15,
]


def test_secret_spans_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(None, HARD[0]), (3, "token=zzzzzzz"), (5000, HARD[7])], "doc_id long, text string")
    for r in secret_trigrams.scan(docs).collect():
        assert [(s.start, s.order, s.end, s.kind) for s in r["__found"] if s.order < 3] == brute_spans(r.text)


def test_trigram_queries_are_necessary():
    for rule in secret_trigrams.RULES:
        query = secret_trigrams.trigram_query(rule.regex)
        for t in HARD:
            if t and re.search(rule.regex, t):
                assert all(any(all(x in t.lower() for x in a) for a in run) for run in query)
    assert secret_trigrams.trigram_query(r"[0-9a-f]{24,}") == []


def test_redaction_and_odd_rows(spark, odd_docs, no_docs):
    got = secret_trigrams.redact(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count()
    text = got.where("doc_id = -9").first().text
    assert "hunter22" not in text and "AKIA" not in text and text.count("[secret]") == 3 and "😀" in text
    assert got.where("doc_id = 2").first().text is None
    assert secret_trigrams.scan(no_docs).count() == 0


def test_shards_merge_and_keep_every_row(spark, odd_docs, no_docs):
    docs = spark.range(0, 4000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").union(odd_docs.select("doc_id", "text"))
    path, small = work_dir(spark, "shards-test"), {"lowest": 4000, "fanout": 4, "tiers": 2}
    assert sharding.append(docs, path, span=32, **small) == 1
    before = sharding.manifest(spark, path)
    n = before.count()
    assert sharding.compact(spark, path, **small) == 2
    after = sharding.manifest(spark, path)
    assert after.count() < n and after.agg(F.sum("rows")).first()[0] == docs.count()
    key = lambda d: Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    assert key(sharding.read(spark, path)) == key(sharding.read(spark, path, 1)) == key(docs)
    assert sharding.append(odd_docs.select("doc_id", "text"), path, span=32, **small) == 3
    assert sharding.read(spark, path).count() == docs.count() + odd_docs.count()
    with pytest.raises(Exception):
        sharding.commit(after, path, 2, docs.schema)
    with pytest.raises(ValueError):
        sharding.append(docs.withColumn("__shard_x", F.lit(1)), path)
    empty = work_dir(spark, "shards-empty")
    sharding.append(no_docs, empty)
    sharding.compact(spark, empty)
    assert sharding.read(spark, empty).count() == 0


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, monkeypatch):
    docs = spark.range(0, 1000).selectExpr("id as doc_id", "repeat('x', 20) as text")
    path, small = work_dir(spark, "shards-dead"), {"lowest": 1000, "fanout": 4, "tiers": 2}
    assert sharding.append(docs, path, span=32, **small) == 1
    for step in ("_write", "commit", "publish"):
        with monkeypatch.context() as m:
            m.setattr(sharding, step, lambda *a: (_ for _ in ()).throw(RuntimeError("dead")))
            for work in (lambda: sharding.append(docs, path, span=32, **small), lambda: sharding.compact(spark, path, **small)):
                with pytest.raises(RuntimeError):
                    work()
        assert sharding.versions(spark, path) == [1] and sharding.read(spark, path).count() == 1000
    assert sharding.compact(spark, path, **small) == 2
    assert sharding.append(docs, path, span=32, **small) == 3
    assert sharding.read(spark, path).count() == 2000 and sharding.read(spark, path, 2).count() == 1000


def test_trees_learn_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4)).astype("f4")
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    t = toxicity.fit_trees(x[:1500], y[:1500])
    assert ((t.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    places, values = toxicity.isotonic(t.margin(x[:1500]), y[:1500])
    assert (np.diff(values) >= 0).all() and (np.diff(places) >= 0).all() and 0 <= values.min() and values.max() <= 1


def test_toxicity_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = catalog.op7_boosted_trees(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.toxic) for r in rows if r.held_out and r.toxic is not None]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.85


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    got = toxicity.score(odd_docs, model, score_col="__s")
    assert got.columns == [*odd_docs.columns, "__s"] and got.where("__s is null or __s < 0 or __s > 1").count() == 0 and got.count() == odd_docs.count()
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels.limit(0)), score_col="__s").count() == 0


def brute_base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def test_language_model_counts(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(gru_lm, "KNOWN", 12)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = gru_lm.score_documents(odd_docs, ~catalog.held_out(7, 2), rounds=1).collect()
    key = lambda t: (str(t[0]), t[2], t[5])
    found = sorted(((r.doc_id, not r.learnt, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(found, sorted(brute_base(rows), key=key)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert gru_lm.score_documents(no_docs, rounds=1).count() == 0


def test_language_model_gradients_and_beats_unigrams(spark, sf):
    known = [(f"w{i}".encode(), 50 - i) for i in range(40)]
    v = gru_lm.Vocabulary(known, {k: (1000, 50) for k in range(gru_lm.KINDS)}, 10, 900, 300)
    rng = np.random.default_rng(1)
    p = {k: (w.astype("f8") + rng.standard_normal(w.shape) * 0.1) for k, w in gru_lm.initial(v).items()}
    m, shape = gru_lm.CLASSES * gru_lm.PER_CLASS, (5, 3)
    x, y, fresh, mask = rng.integers(0, m, shape), rng.integers(0, m, shape), np.zeros(shape, bool), np.ones(shape, bool)
    fresh[0] = fresh[2, 1] = True
    mask[4, 2] = False
    run = lambda q: gru_lm.gradients(q, x, y, fresh, mask, np.zeros((gru_lm.HIDDEN, 3)))
    g = run(p)[0]
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-4
        down[k][i] -= 1e-4
        assert math.isclose(g[k][i], (run(up)[2] - run(down)[2]) / 2e-4, rel_tol=1e-3, abs_tol=1e-6)
    rows = catalog.op9_gru(spark, sf.replace("0.001", "0.01")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_states_are_carried_over_windows(monkeypatch):
    v = gru_lm.Vocabulary([(f"w{i}".encode(), 50 - i) for i in range(40)], {k: (1000, 50) for k in range(gru_lm.KINDS)}, 10, 900, 300)
    p = gru_lm.initial(v)
    p["Wc"] += np.random.default_rng(0).standard_normal(p["Wc"].shape).astype("f4")
    docs = [np.random.default_rng(i).integers(0, 40, 100 + 37 * i).astype("i4") for i in range(5)]
    a = gru_lm.log_likelihoods(p, docs, v.end)
    monkeypatch.setattr(gru_lm, "SCORE_STEPS", 7)
    monkeypatch.setattr(gru_lm, "SCORE_LANES", 2)
    assert np.allclose(a, gru_lm.log_likelihoods(p, docs, v.end), rtol=1e-4)


def test_every_window_gives_a_gradient(monkeypatch):
    v = gru_lm.Vocabulary([(f"w{i}".encode(), 50 - i) for i in range(40)], {k: (1000, 50) for k in range(gru_lm.KINDS)}, 10, 900, 300)
    p, seen, real = gru_lm.initial(v), [], gru_lm.gradients
    monkeypatch.setattr(gru_lm, "gradients", lambda *a: seen.append(int(a[4].sum())) or real(*a))
    short = [np.random.default_rng(i).integers(0, 40, 20).astype("i4") for i in range(30)]
    new, tokens = gru_lm.train(p, iter(short), v.end)
    assert tokens == sum(seen) == 600 and not np.array_equal(new["bc"], p["bc"])
    seen.clear()
    long = [np.random.default_rng(i).integers(0, 40, 300).astype("i4") for i in range(30)]
    assert gru_lm.train(p, iter(long), v.end)[1] == sum(seen) == 9000


def test_one_long_text_among_short_ones_takes_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    v = gru_lm.Vocabulary([(f"w{i}".encode(), 50 - i) for i in range(40)], {k: (1000, 50) for k in range(gru_lm.KINDS)}, 10, 900, 300)
    p, rng = gru_lm.initial(v), np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, 40_000))] + ["w1 zz  W2\n"] * 1000
    whole = list(v.read(pa.array([t.encode() for t in texts], pa.binary())))
    monkeypatch.setattr(gru_lm, "in_parts", lambda t, blanks: words.in_parts(t, blanks, 1 << 14))
    parts = list(v.read(pa.array([t.encode() for t in texts], pa.binary())))
    for k in (2, 4, 5):
        assert np.allclose(np.concatenate([r[k] for r in whole]), np.concatenate([r[k] for r in parts]), rtol=1e-9)
    assert [t for r in whole for t in r[6]] == [t for r in parts for t in r[6]] and whole[-1][6][-1] == {b"zz": 1}
    docs = list(v.ids_of(pa.array([t.encode() for t in texts], pa.binary())))
    assert [len(d) for d in docs] == [40_001] + [4] * 1000
    tracemalloc.start()
    got = gru_lm.log_likelihoods(p, docs, v.end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and len(set(np.round(got[1:], 3))) == 1 and got[0] < got[1]


def test_pieces_of_texts_of_one_length(spark):
    """Rows of an oversized arrival are dealt by a hash of the text, so texts of one length fill all pieces."""
    from pyspark.sql import functions as F

    from tidemark.llm import sharding
    from tidemark.llm.common import work_dir

    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("x" * 90), F.lpad(F.col("id").cast("string"), 10, "0")).alias("text"))
    path = work_dir(spark, "pieces")
    sharding.append(docs, path, lowest=100, fanout=4, tiers=4)
    found = sharding.read(spark, path)
    assert found.count() == 4000
    shards = spark.read.parquet(f"{path}/data").groupBy("__shard_piece").count().collect()
    assert len(shards) == 63 and max(r["count"] for r in shards) < 4 * 4000 / 63
