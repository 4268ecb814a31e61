"""Near duplicates by SimHash and pivot distance tables.

Two modes share the shingle hashes:

* `link_fingerprints`: every pair of fingerprints within `radius` (at most 2) bits, exactly.
* `drop_near_duplicates`: documents whose five-word shingle sets have a Jaccard similarity of at least 0.8.

Pivot distances alone discard pairs but do not find them without trying all, so pairs first share a key: two of four 16-bit blocks (two
differing bits leave at least two blocks untouched). The pivot table then discards pairs by their largest coordinate difference (by the triangle inequality no pair within the radius is
lost), and the survivors are verified. Blocks with more than `SMALL` members are not paired at all: each member joins the 65 centres within
one bit of it; members that meet at a centre are within two bits of each other, and any two within two bits meet at one. A centre has at
most 65 members, so a group of copies of any size costs a fixed number of rows per member.

For the similarity the same links come first, on SimHashes of the shingle sets, and those that have the similarity join their texts. A
distance of fingerprints bounds no Jaccard similarity (at 0.8 some ten bits differ), so what they leave apart is paired by the rarest
shingles of each set, of which any two sets of the similarity share one. Sizes and parity vectors of the sets bound the similarity, and
what they leave is verified on the sets. At shingles of more than `SMALL` texts a few leaders join most of a group before all others meet.

Texts of equal words are one class, numbered by one of its rows. Null texts count as empty. A text without words has fingerprint zero and links like any other. Equal rows stay separate rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import connected_components, map_batches, materialise, own_names

SEED = 42
#: Members of one block that are compared pair by pair; larger blocks go by centres.
SMALL = 64
PIVOTS = 12


def pivot_fingerprints(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of 0, 1, 2, ... as signed 64-bit numbers."""
    return [int(np.array(xxhash.xxh64_intdigest(str(i).encode(), SEED), "u8").view("i8")) for i in range(n)]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each word shingle (ASCII-lower-cased, space-joined, repeats kept); the whole sequence if it has fewer words."""
    w = text.lower().split()
    if not w:
        return np.empty(0, "u8")
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], "u8")
    h, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((h(join(s), SEED) for s in zip(*(w[i:] for i in range(words)))), "u8", len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is one if it is one in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("u8")[0])


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    return (x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist())


def with_fingerprint(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each whole text."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t, words)) for t in _texts(batch, text_col)), "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view("i8"))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("fp", T.LongType())])
    return map_batches(docs.select(id_col, text_col), run, schema)


def pivot_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Adds p0..p(n-1): the Hamming distances to the reference fingerprints."""
    return fps.withColumns({f"p{i}": F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for i, p in enumerate(pivot_fingerprints(n))})


def _may_link(a: str, b: str, radius: int, n: int = PIVOTS) -> Column:
    """No coordinate of the two pivot distances differs by more than the radius, and then the distance itself."""
    kept = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius
    for i in reversed(range(n)):
        kept = (F.abs(F.col(f"{a}.p{i}").cast("int") - F.col(f"{b}.p{i}").cast("int")) <= radius) & kept
    return kept


def link_fingerprints(fps: DataFrame, radius: int = 2, small: int = SMALL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` such that two are connected exactly if a chain of steps of at most 2 bits joins them."""
    if not 0 <= radius <= 2:
        raise ValueError("blocks and centres guarantee a radius of at most 2 bits")
    fps = pivot_table(fps.select("fp").distinct())
    masks = [sum(0xFFFF << (16 * i) for i in pair) for pair in combinations(range(4), 2)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = fps.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("combo", "block"))
    sizes = keyed.groupBy("combo", "block").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(keyed.join(sizes, ["combo", "block"]), "blocks")
    few, many = members.where(F.col("n") <= small), members.where(F.col("n") > small)
    same = (F.col("x.combo") == F.col("y.combo")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.fp") < F.col("y.fp"))
    pairs = few.alias("x").join(few.alias("y"), same & _may_link("x", "y", radius)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if radius < 2:
        reach = F.array(F.col("fp")) if radius == 0 else None
        if reach is None:  # neighbours at one bit are members themselves: a centre that is a member connects only to those one bit away
            flips = F.array(*[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
            ends = many.select("fp").distinct()
            near = ends.select(F.col("fp").alias("a"), F.explode(flips).alias("b")).join(ends.select(F.col("fp").alias("b")), "b").select("a", "b")
            return pairs.unionByName(near.where("a < b")).distinct()
        return pairs.distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])
    centres = many.select("fp").distinct().select("fp", F.explode(around).alias("centre")).groupBy("centre").agg(F.collect_set("fp").alias("met"))
    stars = centres.where(F.size("met") > 1).select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id that can be reached over links), links (fingerprints linked to its own component)."""
    signed = materialise(with_fingerprint(docs, words, id_col, text_col), "simhash")
    classes = materialise(signed.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("copies")), "classes")
    comps = connected_components(link_fingerprints(classes, radius), "simhash")
    own = comps.withColumnRenamed("node", "fp").join(classes, "fp")
    least = own.groupBy("component").agg(F.min("first_id").alias("least_id"), F.count("*").alias("fingerprints"))
    linked = own.join(least, "component").select("fp", "least_id", "fingerprints")
    by_fp = classes.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("fingerprints", F.lit(1).cast("long")).alias("fingerprints"))
    return signed.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fingerprints")


BANDS, ROWS = 16, 3
#: Members of a shingle of many texts that others of it are compared with first, besides its most central one, and such shingles of a text at which it meets them.
LEADERS, LED = 4, 2
#: Bits of the parity vectors that bound how far two shingle sets differ.
PARITY = 512
#: Shingles before a shingle that its row carries, so that a pair that met at one of them does not meet again.
BEFORE = 8
#: Slots in which shingles are counted; four bytes each are sent to every executor.
SLOTS = 1 << 22
#: Slots that travel in one row, and copies of texts that a task remembers.
PIECE, REMEMBERED = 1 << 16, 1 << 17
#: Members in one slice of a shingle that many texts share; slices meet two by two.
SLICE = 256


def minhash_bands(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One signed key for each band of minima over a set of shingle hashes; each minimum is of its own mixed hash, as minima of linear ones go together.

    No step uses them: pairs come from SimHashes and prefixes. Tests hold what such bands find, and miss, against those.
    """
    least = np.zeros(bands * rows, "u8")
    if len(hashes):
        for k in range(bands * rows):
            x = hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            least[k] = x.min() >> np.uint64(17)
    h = xxhash.xxh3_64_intdigest
    return np.array([h(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)], "u8").view("i8").tolist()


def content_key(text: bytes) -> bytes:
    """128 bits of the words in lower case, so texts that differ in white space or case of A-Z are copies."""
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()))


def parity(hashes: np.ndarray) -> list[int]:
    """PARITY bits as signed longs: bit i is one if an odd number of the hashes falls on it. Two sets differ in at least as many hashes as their vectors in bits."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype("i8"), minlength=PARITY) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("i8").tolist()


def signed_documents(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """docs with __uid, __content, and __size, __bits and SimHash __fp of the shingle set, written once so that later steps agree about the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, size, bits, fps = [], [], [], []
            for t in _texts(batch, text_col):
                h = np.unique(shingle_hashes(t, words))
                content.append(content_key(t))
                size.append(len(h))
                bits.append(parity(h))
                fps.append(fingerprint(h))
            more = [pa.array(content, pa.binary()), pa.array(size, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(np.array(fps, "u8").view("i8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__content", "__size", "__bits", "__fp"])

    rows = docs.withColumn("__uid", F.monotonically_increasing_id())
    added = [T.StructField("__content", T.BinaryType()), T.StructField("__size", T.IntegerType()), T.StructField("__bits", T.ArrayType(T.LongType())), T.StructField("__fp", T.LongType())]
    return materialise(map_batches(rows, run, T.StructType([*rows.schema.fields, *added])), "signed")


def _may_reach(similarity: float, a: str = "x", b: str = "y") -> Column:
    """Bounds that no pair of the similarity breaks: the sizes of its sets, and the hashes in which the sets differ, of which the parity bits count no more than there are."""
    p, q = F.col(f"{a}.size"), F.col(f"{b}.size")
    apart = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(PARITY // 64)), F.lit(0))
    return (F.least(p, q) >= similarity * F.greatest(p, q)) & (apart <= (1 - similarity) / (1 + similarity) * (p + q) + 1e-6)


def _ends() -> list[Column]:
    return [F.least("x.content", "y.content").alias("a"), F.greatest("x.content", "y.content").alias("b")]


def fingerprint_pairs(classes: DataFrame, similarity: float, radius: int = 2) -> DataFrame:
    """(a, b) of the classes (content, size, bits, fp) whose SimHashes `link_fingerprints` links and that may reach the similarity.

    Of texts with one fingerprint all meet the first, so a pair costs a row a text or a link, whatever the group's size.
    """
    who = F.struct("content", "size", "bits")
    first = materialise(classes.groupBy("fp").agg(F.min(who).alias("who")).select("fp", "who.*"), "fingerprints")
    same = classes.alias("x").join(first.alias("y"), (F.col("x.fp") == F.col("y.fp")) & (F.col("x.content") != F.col("y.content")) & _may_reach(similarity))
    links = link_fingerprints(first, radius).join(first.alias("x"), F.col("a") == F.col("x.fp")).join(first.alias("y"), (F.col("b") == F.col("y.fp")) & _may_reach(similarity))
    return same.select(*_ends()).unionByName(links.select(*_ends())).distinct()


def slot_counts(rows: DataFrame, words: int, text_col: str, slots: int = SLOTS) -> np.ndarray:
    """How many rows' shingles fall on each of `slots` slots, up to 65,535. Tasks add up their texts; two bytes a slot come to the driver whatever the input."""
    row = "part int, counts binary"

    def pieces(part: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([zlib.compress(np.minimum(c, 65535).astype("u2").tobytes(), 1) for c in counts], pa.binary())], names=["part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(slots, "u4")
        for batch in batches:
            for t in _texts(batch, text_col):
                np.add.at(n, np.unique(shingle_hashes(t, words)).view("i8") % slots, 1)
        if n.any():
            yield pieces(list(range(-(-slots // PIECE))), [n[i : i + PIECE] for i in range(0, slots, PIECE)])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, "u8")
        for table in batches:
            for c in table.column("counts").to_pylist():
                total = total + np.frombuffer(zlib.decompress(c), "u2")
        yield pieces([key[0].as_py()], [total])

    counts = np.ones(slots, "u2")
    for r in map_batches(rows.select(text_col), run, row).groupBy("part").applyInArrow(add, row).collect():
        counts[r["part"] * PIECE : (r["part"] + 1) * PIECE] = np.frombuffer(zlib.decompress(r["counts"]), "u2")
    return counts


def prefix_of(s: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int, int]:
    """The set's shingles (signed) ordered by the count of their slot, then by value; how many of them are of this set only, as their slot counts one; and the length of its prefix."""
    c = counts[s % len(counts)]
    return s[np.lexsort((s, c))], int((c == 1).sum()), len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1


def of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows (key, half), in this order, of keys with several halves. Between batches only the last row is held, and whether its key has given rows."""
    last, given = None, False
    for batch in batches:
        key, half = (batch.column(c).to_numpy() for c in ("key", "half"))
        if last is not None:
            key, half = np.append(last[0], key), np.append(last[1], half)
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (half[1:] != half[:-1]))
        key, half = key[fresh], half[fresh]
        again = key[1:] == key[:-1]
        kept = np.append(False, again) | np.append(again, False)
        last, held = (key[-1:], half[-1:]), bool(kept[-1]) or (given and len(key) == 1)
        kept[0] &= not given
        given = held
        yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(half[kept])], names=["key", "half"])


def shared_prefixes(rows: DataFrame, counts, similarity: float, words: int, text_col: str) -> DataFrame:
    """(key, half): the prefix shingles that texts of different __content hold, and a hash of the content. A task passes over copies that it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = counts.value, set()
        for batch in batches:
            keys, row = [np.zeros(0, "i8")], []
            for i, (t, content) in enumerate(zip(_texts(batch, text_col), batch.column("__content").to_pylist())):
                if content in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(content)
                order, alone, first = prefix_of(np.unique(shingle_hashes(t, words)).view("i8"), n, similarity)
                keys.append(order[alone:first])
                row.append(np.full(len(keys[-1]), i))
            own = batch.column("half").take(pa.array(np.concatenate(row) if row else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), own], names=["key", "half"])

    keyed = map_batches(rows.select(text_col, "__content", F.xxhash64("__content").alias("half")), run, "key long, half long")
    return materialise(map_batches(keyed.repartition("key").sortWithinPartitions("key", "half"), of_several, "key long, half long"), "shared")


def prefix_members(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, n, before, content, size, bits) of the classes that share a prefix shingle; n counts its members, before holds the text's shared shingles just before this one."""
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    sized = sized.withColumn("before", F.collect_list("key").over(Window.partitionBy("half").orderBy("key").rowsBetween(-BEFORE, -1)))
    return materialise(sized.join(classes.select("half", "content", "size", "bits"), "half").drop("half"), "members")


def candidate_pairs(members: DataFrame, similarity: float, small: int = SMALL) -> DataFrame:
    """(a, b) of members that share a shingle of up to `small` members; of larger ones, each member with a few leaders of its LED largest only.

    The leaders are the member that meets most others over all its shingles, and LEADERS drawn by hash. They join most of a group at a cost in
    proportion to its members; `crowd_pairs` gives the pairs of large shingles that are still to be compared. A pair is one row, not one for
    each shingle it shares: it does not meet where both hold one of the shingles just before.
    """
    few, many = members.where(F.col("n") <= small), members.where(F.col("n") > small).select("key", "n", "content", "size", "bits")
    same = F.col("x.key") == F.col("y.key")
    first_met = ~F.arrays_overlap("x.before", "y.before")
    pairs = few.alias("x").join(few.alias("y"), same & (F.col("x.content") < F.col("y.content")) & _may_reach(similarity) & first_met)
    met = many.join(many.groupBy("content").agg(F.sum("n").alias("met")), "content")
    who = F.struct("content", "size", "bits")
    drawn = [F.max_by(who, F.struct("met", "content")), *[F.min_by(who, F.xxhash64(F.lit(k), "content")) for k in range(LEADERS)]]
    leaders = met.groupBy("key").agg(F.array(*drawn).alias("drawn")).select("key", F.explode(F.array_distinct("drawn")).alias("leader")).select("key", "leader.*")
    place = F.row_number().over(Window.partitionBy("content").orderBy(F.desc("n"), "key"))
    led = many.withColumn("place", place).where(F.col("place") <= LED)
    stars = led.alias("x").join(leaders.alias("y"), same & (F.col("x.content") != F.col("y.content")) & _may_reach(similarity))
    return pairs.select(*_ends()).unionByName(stars.select(*_ends())).distinct()


def shingle_counts(each: DataFrame, slots: int) -> np.ndarray:
    """How many of the sets' shingles (column `shingle`) fall on each of `slots` slots, at least 1. Only slots with more than one come to the driver, so no more than `slots` rows whatever the input."""
    at = F.pmod("shingle", F.lit(slots)).cast("int")
    met = each.groupBy(at.alias("slot")).agg(F.least(F.count("*"), F.lit(2**31 - 1)).cast("int").alias("n")).where("n > 1").toArrow()
    counts = np.ones(slots, "i4")
    counts[met.column("slot").to_numpy()] = met.column("n").to_numpy()
    return counts


def prefix_keys(texts: DataFrame, counts, similarity: float) -> DataFrame:
    """One row for each shingle in the prefix of a text (content, size, bits, component, shingles) that another text may hold.

    Shingles are ordered by the count of their slot, then by value: one order for all sets. A slot's count is never below a shingle's own, so
    a shingle whose slot counts one is of this set only; it takes up a place but needs no row. `rest` counts the shingles from this one on.
    """
    own = ["content", "size", "bits", "component"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = counts.value
        for batch in batches:
            row, shingle, rest, before = [], [], [], []
            for i, held in enumerate(batch.column("shingles")):
                s = held.values.to_numpy()
                order, alone, first = prefix_of(s, n, similarity)
                keys = order[alone:first].tolist()
                row += [i] * len(keys)
                shingle += keys
                rest += range(len(s) - alone, len(s) - alone - len(keys), -1)
                before += [keys[max(k - BEFORE, 0) : k] for k in range(len(keys))]
            kept = batch.select(own).take(pa.array(row, pa.int64()))
            more = [pa.array(shingle, pa.int64()), pa.array(rest, pa.int32()), pa.array(before, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*own, "shingle", "rest", "before"])

    return map_batches(texts.select(*own, "shingles"), run, "content long, size int, bits array<long>, component long, shingle long, rest int, before array<long>")


def crowd_pairs(crowd: DataFrame, sets: DataFrame, groups: DataFrame, similarity: float, slots: int = SLOTS) -> DataFrame:
    """(a, b): every pair of the crowd (content, size, bits) that may reach the similarity and that `groups` (content, component) does not join yet.

    With the shingles of each set in one order, rare ones first, two sets of the similarity share one of their first size - similarity * size + 1
    (rounded up to whole shingles), so a shingle that both have there finds them. How rare a shingle is, is told by the count of its slot among
    `slots`: any number of slots gives the same pairs, fewer only more rows. A shingle's members
    are cut into slices, and slices meet two by two: first those outside its largest component with each other, then with the largest one.
    A pair needs to meet only at the first shingle that both have: there the rest of both sets must be large enough for the similarity, and
    no shingle just before it is in both. So a pair whose prefixes agree is one row, not one for each shingle they share.
    """
    labelled = crowd.join(groups, "content", "left").select("content", "size", "bits", F.coalesce("component", "content").alias("component"))
    texts = materialise(labelled.join(sets, "content"), "crowd-sets")
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts.select(F.explode("shingles").alias("shingle")), slots))
    keyed = materialise(prefix_keys(texts, counts, similarity), "prefixes")
    parts = keyed.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    wide = parts.groupBy("shingle").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where(F.col("all") > F.col("top.n"))
    minor = F.ceil((F.col("all") - F.col("top.n")) / SLICE).cast("int")
    slices = wide.select("shingle", F.col("top.component").alias("largest"), minor.alias("minor"), F.ceil(F.col("top.n") / SLICE).cast("int").alias("major"))
    lot = lambda n: F.pmod(F.xxhash64("content"), n).cast("int")
    at = F.when(F.col("component") == F.col("largest"), F.col("minor") + lot(F.col("major"))).otherwise(lot(F.col("minor")))
    dealt = keyed.join(slices, "shingle").withColumn("at", at)
    own = ["shingle", "content", "size", "bits", "component", "rest", "before"]
    x = dealt.where(F.col("at") < F.col("minor")).select(*own, F.col("at").alias("i"), F.explode(F.sequence("at", F.col("minor") + F.col("major") - 1)).alias("j"))
    y = dealt.select(*own, F.explode(F.sequence(F.lit(0), F.least(F.col("at"), F.col("minor") - 1))).alias("i"), F.col("at").alias("j"))
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("shingle", "i", "j")]
    once = (F.col("x.i") < F.col("x.j")) | (F.col("x.content") < F.col("y.content"))
    apart = F.col("x.component") != F.col("y.component")
    enough = F.least("x.rest", "y.rest") >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    first_met = ~F.arrays_overlap("x.before", "y.before")
    return x.alias("x").join(y.alias("y"), meet[0] & meet[1] & meet[2] & once & apart & enough & _may_reach(similarity) & first_met).select(*_ends()).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (content, shingles) have the similarity."""
    x, y = (sets.select(F.col("content").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    sized = F.least(F.size("sa"), F.size("sb")) >= similarity * F.greatest(F.size("sa"), F.size("sb"))
    return pairs.join(x, "a").join(y, "b").where(sized & (both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both))).select("a", "b")


@own_names
def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of docs without near duplicates: of each group of linked texts the row with the smallest id stays (rows without id last).

    Texts link if the Jaccard similarity of their sets of word shingles is at least `similarity`, verified exactly. Links of SimHashes come
    first; pairs that share a shingle of their prefixes follow where those left them apart, so that no pair is missed. At shingles of over
    `small` texts pairs that the links found so far join already are not verified again.
    """
    names = docs.columns
    rows = signed_documents(docs, words, text_col)
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__uid").alias("uid"))
    classes = rows.groupBy("__content").agg(F.min("__uid").alias("content"), F.min(rank).alias("best"), *[F.first(f"__{c}").alias(c) for c in ("size", "bits", "fp")])
    classes = materialise(classes.withColumn("half", F.xxhash64("__content")).drop("__content"), "contents")
    linked = materialise(fingerprint_pairs(classes, similarity), "linked")
    counts = rows.sparkSession.sparkContext.broadcast(slot_counts(rows, words, text_col))
    shared = shared_prefixes(rows, counts, similarity, words, text_col)
    counts.unpersist()
    members = prefix_members(shared, classes)
    pairs = materialise(candidate_pairs(members, similarity, small), "pairs")
    crowd = materialise(members.where(F.col("n") > small).select("content", "size", "bits").dropDuplicates(["content"]), "crowd")
    ends = pairs.unionByName(linked).select(F.explode(F.array("a", "b")).alias("content"))
    wanted = classes.join(ends.unionByName(crowd.select("content")).distinct(), "content").select("content", F.col("best.uid").alias("__uid"))

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, words).view("i8")).tolist() for t in _texts(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(sets, pa.list_(pa.int64()))], names=["content", "shingles"])

    texts = rows.select("__uid", F.col(text_col).alias("__text")).join(wanted, "__uid").select("content", "__text")
    sets = materialise(map_batches(texts, shingle_sets, "content long, shingles array<long>"), "shingle-sets")
    near = materialise(verified(linked, sets, similarity), "near")
    joined = connected_components(near, "simhash").withColumnRenamed("node", "content")
    apart = pairs
    for end in ("a", "b"):
        apart = apart.join(joined.select(F.col("content").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    apart = apart.where(~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False))).select("a", "b")
    edges = materialise(near.unionByName(verified(apart, sets, similarity)), "edges")
    groups = connected_components(edges, "near").withColumnRenamed("node", "content")
    if crowd.limit(1).count():
        more = materialise(verified(materialise(crowd_pairs(crowd, sets, groups, similarity), "crowd-pairs"), sets, similarity), "crowd-edges")
        if more.limit(1).count():
            groups = connected_components(edges.unionByName(more), "near").withColumnRenamed("node", "content")
    best = classes.join(groups, "content", "left").groupBy(F.coalesce("component", "content").alias("group")).agg(F.min("best").alias("best"))
    kept = best.select(F.col("best.uid").alias("__uid"))
    return rows.join(kept, "__uid", "left_semi").select(*names)
