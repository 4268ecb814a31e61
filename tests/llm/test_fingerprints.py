from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bloom_lookup as bl


def dice(a, b):
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return 1.0 if not x and not y else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .\n", max_size=300), min_size=2, max_size=6))
def test_likeness_is_exact(texts):
    keys = [bl.digests(t) for t in texts]
    got = bl.likeness(keys[:-1], keys[1:])
    assert np.allclose(got, [dice(a, b) for a, b in zip(keys, keys[1:])])


def test_peeling_recovers_the_differences_and_retries_larger():
    a = bl.digests("\n".join(f"line number {i}" for i in range(400)))
    b = bl.digests("\n".join(f"line number {i}" for i in range(150, 600)))
    keys, whole = bl.Sketches([a], np.array([8])).minus(bl.Sketches([b], np.array([8]))).peel()
    assert not whole[0]
    assert set(bl.differences([a], [b])[0].tolist()) == set(a.tolist()) ^ set(b.tolist())


def naive(rows):
    """id, length, hash of the edited text and both likenesses of each row, by sorting all of them in one place."""
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (key(r[1]) + (1 << 63)) % (1 << 64), r[1]))
    out = Counter()
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        changed = bl.edited(t, nxt)
        near = [round(dice(bl.digests(t), bl.digests(x)), 9) for x in (changed, nxt)]
        out[(i, len(t), hashlib.sha256(changed.encode()).hexdigest(), *near)] += 1
    return out


def fields(got):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)


def test_query_on_a_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert fields(bl.fingerprint_documents(docs).collect()) == naive([(r.doc_id, r.text or "") for r in docs.collect()])


def test_ids_that_hold_most_rows_are_divided(spark):
    docs = spark.range(1200).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 77 else id end as doc_id", "concat('line ', id % 400, '\\nline ', id % 7) as text")
    dealt = bl.with_following(docs, parts=8)
    assert dealt.where("carried = 0").groupBy("part").count().agg({"count": "max"}).first()[0] < 240
    assert fields(bl.fingerprint_documents(docs).collect()) == naive([(r.doc_id, r.text) for r in docs.collect()])


def test_query_rows(spark, odd_docs, no_docs):
    got = bl.fingerprint_documents(odd_docs).collect()
    assert fields(got) == naive([(r.doc_id, r.text or "") for r in odd_docs.collect()])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert bl.fingerprint_documents(no_docs).count() == 0


def test_next_document_over_many_ranges(spark):
    docs = spark.range(500).selectExpr("id * 7 % 501 as doc_id", "concat('text ', id * 7 % 501) as text")
    got = {r.doc_id: r.edited_sha256 for r in bl.fingerprint_documents(docs).collect()}
    ids = sorted(got)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        assert got[i] == hashlib.sha256(bl.edited(f"text {i}", f"text {j}").encode()).hexdigest()
