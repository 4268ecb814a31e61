"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraph pieces: lines, cut again after sentence ends and every `PIECE_WORDS` words, so that a long paragraph has more
than one digest. Each piece is hashed (its k-th repeat in a text apart from the first) into one cell of each of three subtables; a cell
holds a count, the XOR of the digests and the XOR of their check values. Sketches of two versions subtract cell by cell, and peeling the
cells that hold one digest recovers the digests that differ. If peeling stalls, both are sketched again in larger tables.

The fingerprint is the sketch with `BASE` cells a subtable in hex, so equal texts have equal fingerprints. Likeness is the share of pieces
that two texts have in common, (n + m - d) / (n + m) for d recovered differences; 1 for two empty texts. It is of the tables that peel, which
are larger than the returned fingerprints where texts differ in many pieces; those also hold counts modulo 65,536 and half of each check
value, and serve to find equal texts and small differences. A null text counts as empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches

PIECE_WORDS = 6
#: Cells of each of the three subtables of a fingerprint.
BASE = 8
PIECE = re.compile(rb"(?:[^ \n\t\r]*[^ \n\t\r.!?][ \t\r]+){0,%d}[^ \n\t\r]+" % (PIECE_WORDS - 1))
#: Texts compared in one step, and characters after which a step ends earlier.
STEP, STEP_CHARS = 256, 4 << 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    return x ^ (x >> np.uint64(29))


def digests(text: str) -> np.ndarray:
    """One 64-bit digest for each piece; repeats get digests of their own."""
    h = xxhash.xxh3_64_intdigest
    keys = np.sort(np.fromiter((h(x) for x in PIECE.findall(text.encode())), "u8"))
    if not len(keys):
        return keys
    at = np.arange(len(keys))
    first = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], at, 0))
    return _mix(keys + (at - first).astype("u8") * ODD[1])


class Sketches:
    """The tables of many texts at once; text i has sizes[i] (a power of two) cells a subtable."""

    def __init__(self, keys: list[np.ndarray], sizes: np.ndarray):
        self.sizes, self.off = sizes, np.r_[0, np.cumsum(3 * sizes)]
        total = int(self.off[-1])
        self.count, self.key, self.check = np.zeros(total, "i4"), np.zeros(total, "u8"), np.zeros(total, "u8")
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        self.add(np.concatenate(keys) if keys else np.empty(0, "u8"), owner, np.int32(1))

    def add(self, keys: np.ndarray, owner: np.ndarray, sign) -> np.ndarray:
        at = self.cells(keys, owner)
        np.add.at(self.count, at, sign if np.ndim(sign) == 0 else np.tile(sign, 3))
        np.bitwise_xor.at(self.key, at, np.tile(keys, 3))
        np.bitwise_xor.at(self.check, at, np.tile(_mix(keys * ODD[2]), 3))
        return at

    def cells(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        size, off = self.sizes[owner], self.off[owner]
        return np.concatenate([off + j * size + (_mix(keys ^ ODD[j]) >> np.uint64(7)).astype("i8") % size for j in range(3)])

    def hex(self, i: int) -> str:
        a, b = self.off[i], self.off[i + 1]
        return (self.count[a:b].astype("<u2").tobytes() + self.key[a:b].astype("<u8").tobytes() + self.check[a:b].astype("<u4").tobytes()).hex()

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.sizes, out.off = self.sizes, self.off
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Recovered digests by text, and which texts came out whole. Empties the tables as it goes."""
        n = len(self.sizes)
        got_keys, got_owner = [np.empty(0, "u8")], [np.empty(0, "i8")]
        owner_of = np.repeat(np.arange(n), 3 * self.sizes)
        look = np.arange(len(self.count))
        for _ in range(10_000):
            look = look[np.abs(self.count[look]) == 1]
            look = look[_mix(self.key[look] * ODD[2]) == self.check[look]]
            if not len(look):
                break
            keys, owner, sign = self.key[look], owner_of[look], self.count[look]
            order = np.lexsort((keys, owner))
            keys, owner, sign = keys[order], owner[order], sign[order]
            new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
            keys, owner, sign = keys[new], owner[new], sign[new]
            got_keys.append(keys)
            got_owner.append(owner)
            look = np.unique(self.add(keys, owner, -sign))
        keys, owner = np.concatenate(got_keys), np.concatenate(got_owner)
        left = (self.count != 0) | (self.key != 0)
        whole = ~np.bincount(owner_of[left], minlength=n).astype(bool)
        order = np.argsort(owner, kind="stable")
        return np.split(keys[order], np.cumsum(np.bincount(owner, minlength=n))[:-1]), whole


def differences(a: list[np.ndarray], b: list[np.ndarray], base: int = BASE) -> list[np.ndarray]:
    """The digests in which a[i] and b[i] differ: base tables first, then tables for all pieces of both, then twice that, until all peel."""
    out: list[np.ndarray | None] = [None] * len(a)
    todo, sizes = np.arange(len(a)), np.full(len(a), base)
    while len(todo):
        x, y = ([s[i] for i in todo] for s in (a, b))
        keys, whole = Sketches(x, sizes).minus(Sketches(y, sizes)).peel()
        for k in np.nonzero(whole)[0]:
            out[todo[k]] = keys[k]
        need = np.array([max(1, (len(p) + len(q)) // 2) for p, q in zip(x, y)])
        larger = np.maximum(2 * sizes, 1 << np.ceil(np.log2(need)).astype("i8"))
        todo, sizes = todo[~whole], larger[~whole]
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    totals = [len(p) + len(q) for p, q in zip(a, b)]
    return [1.0 if not t else (t - len(d)) / t for t, d in zip(totals, differences(a, b))]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt into ranges of ascending id, each range also holding (carried = 1) the first row of the next one; the last range that of the first.

    The text is shuffled once. Rows without an id come first; equal ids go by a hash of the text. An id (or none) that holds more rows than
    a range should is divided by that hash. What comes to the driver is the first id and hash of each range, some for each partition.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).withColumn("lot", F.xxhash64(text_col))
    cuts = set(docs.approxQuantile(id_col, [i / (4 * parts) for i in range(1, 4 * parts)], 1 / (16 * parts)))
    counts = docs.groupBy(id_col).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = [(r[0], -(-r["n"] * parts // total)) for r in counts.where(F.col("n") * parts > total).where("n > 1").collect()]
    for i, _ in large:  # a range of its own
        if i is not None:
            cuts |= {float(i), float(np.nextafter(float(i), np.inf))}
    if cuts:
        bounds = Bucketizer(splits=[-np.inf, *sorted(cuts), np.inf], inputCol="number", outputCol="at", handleInvalid="keep")
        docs = bounds.transform(docs.withColumn("number", F.col(id_col).cast("double"))).drop("number")
    else:
        docs = docs.withColumn("at", F.lit(0.0))
    share = F.lit(0)  # of an id's hashes, in its own number of parts
    for i, n in large:
        share = F.when(F.col(id_col).eqNullSafe(F.lit(i)), F.floor((F.shiftright("lot", 32) + (1 << 31)) * n / (1 << 32))).otherwise(share)
    docs = docs.withColumn("part", F.when(F.col(id_col).isNull(), -1).otherwise(F.col("at")).cast("long") * (1 << 32) + share).drop("at")
    heads = docs.groupBy("part").agg(F.min(F.struct(id_col, "lot")).alias("head")).collect()
    order = sorted((r["part"], r["head"][0], r["head"][1]) for r in heads)
    firsts = [(order[k][1], order[k][2], order[k - 1][0]) for k in range(len(order))]
    kind = docs.schema[id_col].dataType.simpleString()
    first = F.broadcast(spark.createDataFrame(firsts, f"head_id {kind}, head_lot long, before long"))
    dealt = docs.join(first, F.col(id_col).eqNullSafe(F.col("head_id")) & (F.col("lot") == F.col("head_lot")), "left")
    own = F.struct("part", F.lit(0).alias("carried"))
    before = F.struct(F.col("before").alias("part"), F.lit(1).alias("carried"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), F.array(own, before)).otherwise(F.array(own))))
    rows = dealt.select(id_col, text_col, "lot", "to.part", "to.carried")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "carried", F.col(id_col).asc_nulls_first(), "lot", text_col).drop("lot")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (against the next id's text; of rows with one id in order of a hash of the text)."""
    kind = docs.schema[id_col].dataType

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "carried", id_col, text_col))):
                if held is not None and held[0] == row[0] and not held[1]:
                    yield held[2], held[3], row[3]
                    held = row
                elif held is None or held[0] != row[0]:
                    held = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for pair in pairs(batches):
            rows.append(pair)
            chars += len(pair[1]) + len(pair[2])
            if len(rows) >= STEP or chars >= STEP_CHARS:
                yield step(rows)
                rows, chars = [], 0
        if rows:
            yield step(rows)

    def step(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, following = zip(*rows)
        known: dict[str, np.ndarray] = {}
        of = lambda t: known.get(t) if t in known else known.setdefault(t, digests(t))
        changed = [edited(t, f) for t, f in zip(texts, following)]
        own, other, cut = [of(t) for t in texts], [of(t) for t in following], [digests(t) for t in changed]
        sizes = np.full(len(rows), BASE)
        a, b = Sketches(own, sizes), Sketches(cut, sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, _arrow(kind)),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([a.hex(i) for i in range(len(rows))]),
                pa.array([b.hex(i) for i in range(len(rows))]),
                pa.array(likeness(own, cut), pa.float64()),
                pa.array(likeness(own, other), pa.float64()),
            ],
            names=[f.name for f in schema.fields],
        )

    text = [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    near = [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_chars", T.LongType()), *text, *near])
    return map_batches(with_following(docs, id_col, text_col), run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[kind]
