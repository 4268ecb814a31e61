from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(rows, docs, window=4096):
    t = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    by_seq, got = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        got[(r.doc_id, r.doc_tokens)].append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    for i, ids in want.items():
        sizes = Counter(len(x) for x in ids)
        for size, copies in sizes.items():
            same = [x for x in ids if len(x) == size]
            pieces = sorted((r.start, r.length, r.ids_crc32) for r in got.pop((i, size)))
            # documents that cannot be told apart by id and size are followed together: each place is covered once for each of them
            cover = np.zeros(size + 1, int)
            for s, n, crc in pieces:
                cover[s] += 1
                cover[s + n] -= 1
                assert any(zlib.crc32(x[s : s + n].tobytes()) == crc for x in same)
            assert (np.cumsum(cover)[:-1] == copies).all()
    assert not got
    assert sum(r.length for r in rows) == sum(len(x) for ids in want.values() for x in ids)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    check_pieces(pk.pack(odd_docs, PATH).collect(), docs)
    check_pieces(pk.pack(odd_docs, PATH, window=64, range_bytes=1000, step_tokens=500).collect(), docs, 64)
    assert pk.pack(no_docs, PATH).count() == 0


def test_word_cache_equals_the_tokenizer():
    t, w = Tokenizer.from_file(PATH), pk.WordTokens(PATH, most=40)
    texts = ["", "<|endoftext|> A<|ENDOFTEXT|>b", "It's Élań  x y\tz İSTANBUL ΣΑΣ won't..!? 12 3<|", "a.b,c!\r\nDon'T 'S éé, é. ½. 5%, …, ok..., (x)"] * 3
    for _ in range(3):
        for together in (1 << 20, 40, 7):
            got, rows = [], 0
            for lo, hi, ids, ends in w.encode_in_parts(pa.array([x.encode() for x in texts], pa.binary()), 2, together):
                assert lo == rows and len(ends) == hi - lo and ends[-1] == len(ids)
                rows = hi
                got += [x.tolist() for x in np.split(ids, ends[:-1])]
            assert rows == len(texts) and got == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


@settings(max_examples=160, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.integers(1, 40), st.sampled_from([250, 256, 700, 1100])), st.booleans()), min_size=1, max_size=60), st.sampled_from([32, 1024]))
def test_cuts_have_least_cost(parts, window):
    ends, inner, at = [], [], 0
    for n, is_doc in parts:
        at += n
        (ends if is_doc else inner).append(at)
    got = pk.cuts(np.array(ends, int), np.array(inner, int), at, window)
    assert got[-1] == at and all(b - a <= window for a, b in zip([0, *got], got))
    penalty = dict.fromkeys(inner, pk.SENTENCE_CUT) | dict.fromkeys(ends, 0) | {at: 0}
    pos, last = [0], 0
    for p in sorted(penalty):
        while p - last > window:
            last += window
            pos.append(last)
        if p > last:
            pos.append(p)
            last = p
    pad = lambda n: 0 if n >= 256 and n & (n - 1) == 0 else window - n
    best = {0: 0}
    for j, p in enumerate(pos[1:], 1):
        best[p] = min(best[q] + pad(p - q) for q in pos[:j] if p - q <= window) + penalty.get(p, pk.INNER_CUT)
    cost = sum(pad(b - a) + penalty.get(b, pk.INNER_CUT) for a, b in zip([0, *got], got))
    assert cost == best[at]


def test_little_padding(spark, sf):
    rows = pk.pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH).groupBy("sequence_id").sum("length").collect()
    n = [r[1] for r in rows]
    assert sum(4096 - x if x & (x - 1) else 0 for x in n) < 0.03 * sum(n)
