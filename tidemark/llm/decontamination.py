"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

Words are runs of letters, digits and underscores in lower case; a shingle is five words (all words of an item that has fewer). A window of
a document as long as an item, in words, matches it if the weighted Jaccard similarity of their shingle multisets (weight: times that the
shingle occurs) is at least 0.8. With an item's shingles in one order, rarest among the items first, such a window holds one of the first
fifth, so only windows around those meet the item: each of them, at every place. Their SimHashes pass if one of four 16-bit blocks differs
from the item's in at most a quarter of `RADIUS`, as one must within the radius, and all of it in at most the radius. What passes is
verified exactly. Blocks alone would not do: at a similarity of 0.8 the expected distance is 10 of 64 bits with a deviation of 3, so a
radius of 20 keeps practically all, but at that radius a third of all unrelated items agree in some block.

Items go to the tasks in blocks of at most `BLOCK_BYTES` of text, one pass over the documents each; documents are never shuffled. Null or
wordless texts and items match nothing. A text of any length takes 8 bytes a word and a bounded stretch of bit sums. Repeated rows are reported as often as they stand; repeated items with an id each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"\w+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(m[0]) for m in WORD.finditer((text or "").lower())), "u8")


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of hashed words."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, "u8")
    out = w[:n].copy()
    for i in range(1, k):
        out = out * PRIME + w[i : i + n]
    return out ^ (out >> np.uint64(29))


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """Row i: for each bit, ones less zeros among the first i hashes."""
    bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("i4") * 2 - 1
    return np.vstack([np.zeros((1, 64), "i4"), np.cumsum(bits, axis=0, dtype="i4")])


def pack_signs(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("u8").ravel()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Items:
    """The index of one block of items."""

    def __init__(self, rows: list[tuple], shingle: int = SHINGLE, radius: int = RADIUS, least: float = SIMILARITY):
        self.radius, self.least = radius, least
        self.ids, self.bags, sizes, widths, prints, all_shingles = [], [], [], [], [], []
        for item_id, text in rows:
            w = words(text)
            if not len(w):
                continue
            k = min(shingle, len(w))
            s = shingles(w, k)
            prints.append(pack_signs(bit_sums(s)[-1:])[0])
            self.ids.append(item_id)
            sizes.append(len(w))
            widths.append(k)
            self.bags.append(Counter(s.tolist()))
            all_shingles.append(s)
        self.sizes, self.widths, self.prints = np.array(sizes, "i8"), np.array(widths, "i8"), np.array(prints, "u8")
        held = Counter(x for bag in self.bags for x in bag)
        owners: dict[int, defaultdict[int, list[int]]] = {}
        for i, s in enumerate(all_shingles):
            ranked = sorted(s.tolist(), key=lambda x: (held[x], x))
            for x in set(ranked[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]):
                owners.setdefault(widths[i], defaultdict(list))[x].append(i)
        #: By shingle width: the shingles that find items, where each one's items begin, and the items.
        self.known = {}
        for k, found in owners.items():
            order = sorted(found)
            self.known[k] = np.array(order, "u8"), np.cumsum([0, *(len(found[x]) for x in order)]), np.array([i for x in order for i in found[x]], "i8")

    def stretches(self, s: np.ndarray, k: int, n_words: int) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): the windows at first to last hold a shingle that finds the item; each window once for each item."""
        known, begin, items = self.known[k]
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        hits = np.nonzero(known[at] == s)[0]
        each = (begin[1:] - begin[:-1])[at[hits]]
        item = items[np.repeat(begin[at[hits]] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        place, size = np.repeat(hits, each), self.sizes[item]
        order = np.lexsort((place, item))
        item, place, size = item[order], place[order], size[order]
        first, last = np.maximum(0, place + k - size), np.minimum(place, np.maximum(0, n_words - size))
        new = np.append(True, (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 1)) if len(item) else np.empty(0, bool)
        lo = np.nonzero(new)[0]
        yield from zip(item[lo].tolist(), first[lo].tolist(), last[np.append(lo[1:], len(item)) - 1].tolist() if len(lo) else [])

    def matches(self, text: str | None, stretch: int = 1 << 16) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window for each item that the text holds; of equal ones the first."""
        w = words(text)
        best: dict[int, tuple] = {}
        for k in self.known:
            s = shingles(w, k)
            for i, first, last in self.stretches(s, k, len(w)) if len(s) else ():
                n = int(self.sizes[i])
                for a in range(first, last + 1, stretch):
                    starts = np.arange(a, min(a + stretch, last + 1))
                    ends = np.minimum(starts + max(1, n - k + 1), len(s))
                    sums = bit_sums(s[a : ends[-1]])
                    apart = pack_signs(sums[ends - a] - sums[starts - a]) ^ self.prints[i]
                    near = np.bitwise_count(apart.view("u2").reshape(-1, 4)).min(axis=1) <= self.radius // 4
                    near &= np.bitwise_count(apart) <= self.radius
                    for j in np.nonzero(near)[0].tolist():
                        b, e = int(starts[j]), int(ends[j])
                        value = similarity(Counter(s[b:e].tolist()), self.bags[i])
                        if value >= self.least and (i not in best or (-value, b) < (-best[i][1], best[i][2])):
                            best[i] = (self.ids[i], value, b, min(n, len(w) - b))
        return [best[i] for i in sorted(best)]


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    items = benchmark.select(F.col(item_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64(text_col, item_col), F.lit(n)) == b)
        yield [tuple(r) for r in block.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds: id, item id, similarity, first_word and words of the best window."""
    id_field = T.StructField(id_col, docs.schema[id_col].dataType)
    item_field = T.StructField(item_col, benchmark.schema[item_col].dataType)
    schema = T.StructType([id_field, item_field, T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("words", T.LongType())])
    passes = []
    for rows in _item_blocks(benchmark, item_col, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, shingle, least=similarity)
            kind = pa.array([r[0] for r in sent.value]).type if sent.value else pa.int64()
            for batch in batches:
                at, found = [], []
                for i, text in enumerate(batch.column(text_col).to_pylist()):
                    for m in items.matches(text):
                        at.append(i)
                        found.append(m)
                columns = [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * 4, (kind, pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at, pa.int64())), *columns], names=schema.names)

        passes.append(map_batches(docs.select(id_col, text_col), run, schema))
    return reduce(DataFrame.unionByName, passes)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    for rows in _item_blocks(benchmark, item_col, item_text, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, shingle, least=similarity)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(t) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, docs.schema)
    return docs
