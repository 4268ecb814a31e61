from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_pivots as sh
from tidemark.llm.common import connected_components


def brute_fp(t, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    p = list(range(len(items)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = find(i), find(j)
                p[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(items))]


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[1001] == 1000


def test_links_are_exact_for_small_and_large_blocks(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(150):
        x = centre
        for _ in range(rng.randrange(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [int(np.array(x, "u8").view("i8")) for x in fps]
    want = components(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    for small in (4, 64, 10_000):
        edges = sh.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, small)
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
        got = {r.node: r.component for r in connected_components(edges).collect()}
        label = [got.get(x, x) for x in signed]
        assert [label.index(v) for v in label] == want


def test_documents(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    got = sh.simhash_components(odd_docs).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), format(brute_fp(r.text), "016x")) for r in rows)
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {2}
    assert sh.simhash_components(no_docs).count() == 0


def test_dropping_keeps_one_of_each_group(spark, odd_docs, no_docs):
    kept = sh.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == [(False, -9), (False, 1), (False, 2), (False, 5), (False, 7), (False, 7)]
    assert sh.drop_near_duplicates(no_docs).count() == 0


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(4000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(4):
            t = base[:]
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(120)] = rng.choice(vocab)
            texts.append(" ".join(t))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    want = components(list(range(len(texts))), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in sh.drop_near_duplicates(docs).collect()} == set(want)


def test_edited_copies_that_only_meet_at_their_original(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        t = base[:]
        for i in rng.sample(range(200), 4):
            t[i] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    texts.append(" ".join(base))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in sh.drop_near_duplicates(docs).collect()] == [0]


def test_large_bands_lose_no_pair(spark):
    rng = random.Random(6)
    form = [f"f{i}" for i in range(110)]
    texts = []
    for _ in range(90):
        own = [f"o{rng.randrange(10**9)}" for _ in range(60)]
        texts += [" ".join(form + own), " ".join(form + own[:-3] + [f"p{rng.randrange(10**9)}" for _ in range(3)])]
    for t in range(30):
        own = [f"q{rng.randrange(10**9)}" for _ in range(60)]
        for k in range(4):  # a chain: each is near the next, the ends are not
            texts.append(" ".join(form + own[k * 8 :] + [f"c{t}x{i}" for i in range(k * 8)]))
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    want = components(list(range(len(texts))), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    assert len(set(want)) == 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small in (8, 64):
        assert {r.doc_id for r in sh.drop_near_duplicates(docs, small=small).collect()} == set(want)


def test_prefixes_find_every_pair_whatever_the_slots(spark):
    rng = np.random.default_rng(4)
    form = rng.integers(-(2**62), 2**62, 160)
    rows = []
    for k in range(60):
        own = rng.integers(-(2**62), 2**62, 16)
        rows += [(3 * k + i, np.unique(np.concatenate([form[: 120 + k % 40], own[: 16 - 2 * i]])).tolist()) for i in range(3)]
    rows += [(1000, []), (1001, form[:1].tolist())]
    sets = spark.createDataFrame(rows, "content long, shingles array<long>")
    crowd = spark.createDataFrame([(i, len(s), sh.parity(np.array(s, "i8").view("u8"))) for i, s in rows], "content long, size int, bits array<long>")
    groups = spark.createDataFrame([(3 * k + i, 3 * k) for k in range(0, 60, 2) for i in range(2)], "content long, component long")
    joined = {(3 * k, 3 * k + 1) for k in range(0, 60, 2)}
    held = [(i, set(s)) for i, s in rows if s]
    want = {(i, j) for i, s in held for j, t in held if i < j and len(s & t) >= 0.8 * len(s | t)} - joined
    assert len(want) > 500
    for slots in (1, 7, 1 << 16):
        pairs = sh.crowd_pairs(crowd, sets, groups, 0.8, slots)
        assert {(r.a, r.b) for r in sh.verified(pairs, sets, 0.8).collect()} == want


def test_a_line_that_repeats_hides_no_copy(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for k in range(40):
        own, line = ([f"v{rng.randrange(10**6)}" for _ in range(n)] for n in (200, 8))
        rows += [(2 * k, " ".join(own + line)), (2 * k + 1, " ".join(own + line * 100))]
        want.add(2 * k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in sh.drop_near_duplicates(docs).collect()} == want


def test_pairs_at_the_similarity_share_a_band():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        a = rng.integers(0, 2**63, 196, dtype="u8")
        b = np.append(a[20:], rng.integers(0, 2**63, 20, dtype="u8"))
        assert any(x == y for x, y in zip(sh.minhash_bands(a), sh.minhash_bands(b)))


def test_a_pair_that_shares_no_band_of_minima_is_found(spark):
    rng = random.Random(236986)  # one of some 100,000 at this similarity
    a = [f"v{rng.randrange(10**6)}" for _ in range(103)]
    b = a[:92] + [f"n{rng.randrange(10**6)}" for _ in range(11)]
    x, y = (np.unique(sh.shingle_hashes(" ".join(t).encode(), 5)) for t in (a, b))
    assert len(np.intersect1d(x, y)) == 88 and len(np.union1d(x, y)) == 110
    assert not any(p == q for p, q in zip(sh.minhash_bands(x), sh.minhash_bands(y)))
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "other words")], "doc_id long, text string")
    assert {r.doc_id for r in sh.drop_near_duplicates(docs).collect()} == {1, 3}


def test_fingerprints_link_first(spark, monkeypatch):
    """Copies with some changed words go by SimHashes within two bits; the pivot table sees the fingerprints of the shingle sets."""
    rng, rows = random.Random(2), []
    for k in range(20):
        t = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(3 * k + i, " ".join(t[: 400 - i])) for i in range(3)]
    calls, real = [], sh.fingerprint_pairs
    monkeypatch.setattr(sh, "fingerprint_pairs", lambda *a: calls.append(real(*a)) or calls[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in sh.drop_near_duplicates(docs).collect()} == {3 * k for k in range(20)}
    sets = [np.unique(sh.shingle_hashes(t.encode(), 5)) for _, t in rows]
    fps = [sh.fingerprint(s) for s in sets]
    groups = components(list(range(60)), lambda i, j: i // 3 == j // 3 and bin(fps[i] ^ fps[j]).count("1") <= 2)
    found = connected_components(calls[0]).agg(F.count("*"), F.count_distinct("component")).first()
    assert found[0] - found[1] == 60 - len(set(groups)) > 20


def test_slots_count_every_row_once(spark):
    docs = spark.createDataFrame([("a b c d e f",), ("a b c d e f a b c d e",), (None,)], "text string")
    counts = sh.slot_counts(docs, 5, "text", 1 << 17)
    each = [sh.shingle_hashes(t, 5).view("i8") % (1 << 17) for t in (b"a b c d e f", b"a b c d e f a b c d e")]
    want = sum(np.bincount(np.unique(e), minlength=1 << 17) for e in each)
    assert (counts == want).all() and counts.max() == 2


def test_rows_of_several_whatever_the_batches():
    rng = np.random.default_rng(1)
    rows = sorted((int(k), int(h)) for k, h in zip(rng.integers(0, 60, 300), rng.integers(0, 3, 300)))
    rows += [(100, 1)] * 5 + [(101, k) for k in range(9)] + [(102, 7)]
    want = sorted({r for r in rows if len({h for k, h in rows if k == r[0]}) > 1})
    for n in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + n]], pa.int64()) for c in (0, 1)], names=["key", "half"]) for i in range(0, len(rows), n)]
        got = [(r["key"], r["half"]) for b in sh.of_several(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
        assert got == want
