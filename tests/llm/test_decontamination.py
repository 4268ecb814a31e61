from __future__ import annotations

import random
import time
from collections import Counter

from tidemark.llm import decontamination as dc

ITEM = " ".join(f"word{i}" for i in range(40))


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "just three words"), (3, None), (4, ""), (5, ITEM)], "item_id long, text string")


def test_exact_edited_and_clean(spark):
    w = ITEM.split()
    edited = w[:20] + ["changed"] + w[21:]
    docs = spark.createDataFrame(
        [(1, "before. " + ITEM.upper() + " after"), (2, "x y " + " ".join(edited) + " z"), (3, " ".join(w[:15])), (4, "clean text about other things entirely"), (5, "JUST  three, words!"), (6, None), (7, "")],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r for r in dc.find_leaks(docs, items(spark)).collect()}
    assert set(got) == {(1, 1), (1, 5), (5, 2)}  # one changed word of 40 takes 5 of 36 shingles: 31 / 41
    assert got[(1, 1)].similarity == 1.0 and got[(1, 1)].first_word == 1 and got[(1, 1)].words == 40
    kept = {r.doc_id for r in dc.drop_leaks(docs, items(spark)).collect()}
    assert kept == {1, 2, 3, 4, 5, 6, 7} - {i for i, _ in got}


def test_every_window_against_brute_force():
    rng = random.Random(5)
    item = [f"w{i}" for i in range(30)]
    index = dc.Items([(9, " ".join(item))])
    for _ in range(60):
        body = item[:]
        for _ in range(rng.randrange(0, 4)):
            body[rng.randrange(30)] = f"n{rng.random()}"
        doc = [f"a{i}" for i in range(rng.randrange(9))] + body + [f"b{i}" for i in range(rng.randrange(9))]
        bag = lambda ws: Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        best = max(dc.similarity(bag(doc[s : s + 30]), bag(item)) for s in range(len(doc) - 29))
        got = index.matches(" ".join(doc))
        assert (bool(got) and abs(got[0][1] - best) < 1e-12) if best >= 0.8 else not got


def naive_best(doc, item, k):
    """The best similarity of an item-sized window, from all windows."""
    bag = lambda ws: Counter(tuple(ws[i : i + k]) for i in range(max(0, len(ws) - k + 1)))
    n = len(item)
    return max((dc.similarity(bag(doc[s : s + n]), bag(item)) for s in range(max(1, len(doc) - n + 1))), default=0.0) if len(doc) >= k else 0.0


def test_many_items_of_several_sizes_against_brute_force():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(400)}"
    mould = [f"m{i}" for i in range(12)]  # a passage that many items share
    items = []
    for i in range(200):
        body = [word() for _ in range(rng.choice([2, 5, 6, 9, 20, 33, 60, 150]))]
        items.append(mould + body if i % 4 == 0 else body * 2 if i % 9 == 0 else body)
    index = dc.Items([(i, " ".join(x)) for i, x in enumerate(items)])
    found = wanted = 0
    for d in range(30):
        doc = [word() for _ in range(rng.randrange(20))]
        for i in rng.sample(range(200), 3):
            body = items[i][:]
            for _ in range(rng.randrange(0, 1 + len(body) // 25)):
                body[rng.randrange(len(body))] = "new" + word()
            doc += body + [word() for _ in range(rng.randrange(6))]
        if d % 10 == 0:
            doc = items[d][: max(3, len(items[d]) - 2)]  # shorter than the item
        want = {i: v for i, x in enumerate(items) if (v := naive_best(doc, x, min(5, len(x)))) >= 0.8}
        got = {m[0]: m[1] for m in index.matches(" ".join(doc))}
        assert set(got) <= set(want) and all(abs(got[i] - want[i]) < 1e-12 for i in got)
        assert got == {m[0]: m[1] for m in index.matches(" ".join(doc), stretch=7)}
        found, wanted = found + len(got), wanted + len(want)
    assert wanted > 60 and found >= 0.995 * wanted


def test_time_hardly_depends_on_the_number_of_items():
    rng = random.Random(2)
    mould = " ".join(f"m{i}" for i in range(8))
    items = [(i, mould + " " + " ".join(f"x{rng.randrange(5000)}" for _ in range(30))) for i in range(8000)]
    doc = " ".join([*(f"y{rng.randrange(5000)}" for _ in range(400)), items[7][1], mould, items[9][1], *(f"x{rng.randrange(5000)}" for _ in range(400))])
    few, many = dc.Items(items[:500]), dc.Items(items)

    def took(index):
        times = []
        for _ in range(15):
            start = time.perf_counter()
            assert {7, 9} <= {m[0] for m in index.matches(doc)}
            times.append(time.perf_counter() - start)
        return min(times)

    assert took(many) < 2 * took(few)


def test_item_blocks_and_odd_rows(spark, odd_docs, no_docs):
    b = items(spark)
    one = Counter((r.doc_id, r.item_id) for r in dc.find_leaks(odd_docs, b).collect())
    many = Counter((r.doc_id, r.item_id) for r in dc.find_leaks(odd_docs, b, block_bytes=100).collect())
    assert one == many
    assert dc.drop_leaks(odd_docs, b).columns == odd_docs.columns
    assert dc.drop_leaks(odd_docs, b).count() == odd_docs.count()
    assert dc.find_leaks(no_docs, b).count() == 0 and dc.find_leaks(odd_docs, b.limit(0)).count() == 0
