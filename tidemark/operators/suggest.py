"""Suggestions for names that are not known: every known name above a similarity, found over what deletions leave, segments or (long names) rare bigrams, the best few for each name."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

#: Names meet at their rests, which are what a few deletions leave, where the longer one has up to SHORT letters and the similarity allows up to EDITS edits.
SHORT, EDITS = 20, 3
#: Binary digits of the table's slots in which the rests of one side are looked up before they become rows; any number gives the same pairs.
SLOTS = 27
#: Rests that a task joins, or so; it makes twice as many.
TASK = 200_000
#: Odd factors of the rests' numbers.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text whose words are counted together, or one text; words that a task holds before it sends them on, or so.
TOGETHER, HELD = 8 << 20, 1 << 20


def word_counts(texts: DataFrame, text: str, least: int) -> DataFrame:
    """(word, n): how often each run of at least so many letters a to z occurs in the texts in lower case. Null texts have none.

    Only the dotted I and the Kelvin sign have an ASCII letter as lower case besides A to Z. Each distinct word of many megabytes becomes one row.
    """

    def counted(some):
        at = np.frombuffer(some.buffers()[1], "<i4")[some.offset : some.offset + len(some) + 1].astype("i8")
        raw = np.frombuffer(some.buffers()[2] or b"", "u1")[at[0] : at[-1]]
        at, low = at - at[0], raw | np.uint8(32)
        letter = (low - np.uint8(97)) < 26
        first, last = letter.copy(), letter.copy()
        first[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        head, tail = at[at < len(raw)], at[at > 0] - 1  # words end with their text
        first[head], last[tail] = letter[head], letter[tail]
        first, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        held = end - first >= least
        first, end = first[held], end[held]
        edge = np.zeros(len(raw) + 1, "i1")
        edge[first] += 1
        edge[end] -= 1
        letters = low[np.cumsum(edge[:-1], dtype="i1").view(bool)]
        cuts = np.concatenate([[0], np.cumsum(end - first)]).astype("i4")
        n = pc.value_counts(pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]))
        return pa.table({"word": n.field("values"), "n": n.field("counts")})

    def merged(held):
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches):
        held = []
        for batch in batches:
            column = batch.column(0).drop_null().cast(pa.string())
            at = np.frombuffer(column.buffers()[1] or b"\0\0\0\0", "<i4")[column.offset : column.offset + len(column) + 1].astype("i8")
            lo = 0
            while lo < len(column):
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + TOGETHER, "right")) - 1)
                some = pc.replace_substring(pc.replace_substring(column.slice(lo, hi - lo), "\u0130", "i"), "\u212a", "k")
                held.append(counted(some))
                lo = hi
                if sum(map(len, held)) > HELD:
                    held = [merged(held)]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    return texts.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
#: Names of more letters than this are paired over bigrams, as their segments have too many places.
LONG = 32
#: Bigrams are taken of a name with this before and after it.
EDGE = "\x02"


def bigrams(name: Column) -> Column:
    """The bigrams of a name, each with the number of its occurrence, so that they form a set: length + 1 of them."""
    padded = F.concat(F.lit(EDGE), name, F.lit(EDGE))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, 2))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda h: h == g)).cast("string")))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer name; exact doubles of whole numbers."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _segment(m: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of part i of a name of m letters that is cut into d + 1 parts."""
    cut = lambda k: F.floor(k * m / (d + 1)).cast("int")
    return cut(i), cut(i + 1) - cut(i)


def letters(name: Column) -> Column:
    """64 bits: one is set for each letter (code modulo 64) that occurs an odd number of times; an edit changes at most two."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64)).cast("int"))
    return F.aggregate(F.split(name, ""), F.lit(0).cast("long"), lambda s, c: F.when(c == "", s).otherwise(s.bitwiseXOR(bit(c))))


def _edits(letters: int, least: float) -> int:
    """The edits that the similarity allows a pair whose longer name has so many letters."""
    return math.floor((1 - least) * letters + 1e-9)


def _reach(least: float) -> int:
    """The letters of the longer name up to which pairs meet at their rests."""
    return max(n for n in range(1, SHORT + 1) if _edits(n, least) <= EDITS)


def _losses(letters: int, edits: int, least: float) -> list[int]:
    """How many letters a name loses for its rests at so many edits: all of them as the longer one of a pair, fewer by the difference in length as the shorter one."""
    return [edits - more for more in range(edits + 1) if letters + more <= _reach(least) and edits <= _edits(letters + more, least)]


def _ahead(letters: int, edits: int, least: float) -> float:
    """The best similarity that a name can have to those it has not met when all pairs within reach up to so many edits are found; 0 if no such pair is similar."""
    best = 0.0
    for other in range(max(1, math.ceil(least * letters - 1e-9)), math.floor(letters / least + 1e-9) + 1):
        longer, differ = max(letters, other), abs(letters - other)
        fewest = max(edits + 1, differ) if longer <= _reach(least) else differ
        if fewest <= _edits(longer, least):
            best = max(best, 1 - fewest / longer)
    return best


def _rests(df: DataFrame, c: str, edits: int, least: float, tasks: int, table=None, slots: int = SLOTS) -> DataFrame:
    """(key, name): a number for each rest of each name at so many edits, equal for equal rests; with a table only those that fall on its slots. Tasks hold a few thousand names' rests at a time."""
    losses = {n: _losses(n, edits, least) for n in range(1, _reach(least) + 1)}
    back = [np.uint64(pow(BASE, -k, 2**64)) for k in range(edits + 1)]
    powers, mix = np.array([pow(BASE, k + 1, 2**64) for k in range(SHORT)], "u8"), np.uint64(MIX)

    def keys(letters, lost):
        """A row a name: sum of letter times power of its place over the letters that are left. Sums from the first letter on give each stretch between two deletions."""
        n = letters.shape[1]
        sums = np.zeros((len(letters), n + 1), "u8")
        np.cumsum(letters * powers[:n], axis=1, out=sums[:, 1:])
        gone = np.array(list(combinations(range(n), lost)), int).reshape(math.comb(n, lost), lost)
        out, start = np.zeros((len(letters), len(gone)), "u8"), np.zeros(len(gone), int)
        for k in range(lost + 1):
            end = gone[:, k] if k < lost else np.full(len(gone), n)
            out += (sums[:, end] - sums[:, start]) * back[k]
            start = end + 1
        out = (out ^ (out >> np.uint64(32))) * mix
        out = np.sort(out ^ (out >> np.uint64(29)), axis=1)
        kept = np.ones(out.shape, bool)
        kept[:, 1:] = out[:, 1:] != out[:, :-1]  # a rest that several deletions leave counts once
        if table is not None:
            at = out >> np.uint64(64 - slots)
            kept &= (table.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return np.nonzero(kept)[0], out[kept]

    def run(batches):
        for batch in batches:
            by_length = {}
            for x in batch.column(0).to_pylist():
                by_length.setdefault(len(x), []).append(x)
            for n, names in by_length.items():
                for lost in losses.get(n, []):
                    step = max(1, (1 << 18) // math.comb(n, lost))
                    for k in range(0, len(names), step):
                        some = names[k : k + step]
                        letters = np.frombuffer("".join(some).encode("utf-32-le"), "u4").reshape(-1, n).astype("u8") + np.uint64(1)
                        rows, key = keys(letters, lost)
                        yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(some, pa.string()).take(pa.array(rows))], names=["key", c])

    lengths = [n for n, lost in losses.items() if lost]
    return df.select(c).where(F.length(c).isin(lengths)).repartition(tasks, c).mapInArrow(run, f"key long, {c} string")


def rest_pairs(left: DataFrame, right: DataFrame, edits: int, least: float) -> DataFrame | None:
    """(a, b, similarity): the similar pairs at exactly so many edits among the names a and b whose longer one is within reach; None if there are no such names.

    Such a pair shares what is left when the longer one loses as many letters as there are edits and the shorter one fewer by the difference in length. The side with fewer
    rests marks a table, so most rests of the other one never become rows; those that meet are verified.
    """
    spark = left.sparkSession
    lengths = [df.where(F.length(c) <= _reach(least)).groupBy(F.lit(c).alias("c"), F.length(c).alias("m")).agg(F.count("*").alias("n")) for df, c in ((left, "a"), (right, "b"))]
    size = {"a": 0, "b": 0}
    for r in lengths[0].unionByName(lengths[1]).collect():
        size[r.c] += sum(r.n * math.comb(r.m, lost) for lost in _losses(r.m, edits, least))
    (few, c), (many, d) = sorted([(left, "a"), (right, "b")], key=lambda x: size[x[1]])
    if not size[c]:
        return None
    slots = min(SLOTS, max(7, (16 * size[c]).bit_length()))
    few = _rests(few, c, edits, least, 1 + size[c] // (2 * TASK))
    at = F.shiftrightunsigned("key", 64 - slots)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    marked = few.groupBy(F.shiftrightunsigned("key", 64 - slots + 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << (slots - 6), "i8")
    table[marked.column("word").to_numpy()] = marked.column("bits").to_numpy()
    many = _rests(many, d, edits, least, 1 + size[d] // (2 * TASK), spark.sparkContext.broadcast(table.view("u8")), slots)
    tasks = 1 + (size[c] + size[d] // 8) // TASK  # few bytes, much work: not to be merged into few tasks
    near = 1 - F.lit(edits) / F.greatest(F.length("a"), F.length("b"))
    met = few.repartition(tasks, "key").join(many.repartition(tasks, "key"), "key")
    return met.where((F.levenshtein("a", "b", edits) == edits) & (near >= least - 1e-12)).select("a", "b").distinct().withColumn("similarity", near)


def segment_pairs(left: DataFrame, right: DataFrame, least: float, over: int = 0) -> DataFrame:
    """(a, b): the pairs of the similarity among the names a and b whose longer one has over so many letters.

    The longer name's length gives the edits d that the similarity allows. Of d + 1 parts of b one stands in a unchanged, with at most i edits before part i and d - i
    after it, so it starts there at one of few places.
    Of the pairs that meet there, those whose letters allow d edits are verified.
    """
    whole = lambda c: F.floor(c + 1e-9).cast("int")
    share, n, m, d, i = 1 - least, F.length("a"), F.length("b"), F.col("d"), F.col("i")
    each = lambda df: df.withColumn("i", F.explode(F.sequence(F.lit(0), d)))
    start, size = _segment(F.col("m"), d, i)
    parts = each(right.select("b", letters(F.col("b")).alias("of_b"), m.alias("m"), F.explode(F.sequence(whole(share * m), whole(share * whole(m / least)))).alias("d")).where(F.col("d") >= _edits(over + 1, least))).select("b", "of_b", "m", "d", "i", F.substring(F.col("b"), start + 1, size).alias("part"))
    lengths = left.select("a", letters(F.col("a")).alias("of_a"), n.alias("n"), F.explode(F.sequence(F.ceil(least * n - 1e-9).cast("int"), whole(n / least))).alias("m"))
    asked = each(lengths.where(F.greatest("n", "m") > over).withColumn("d", whole(share * F.greatest("n", "m")))).withColumns({"start": start, "size": size, "more": F.col("n") - F.col("m")})
    low = F.greatest(F.col("start") - i, F.col("start") + F.col("more") - (d - i), F.lit(0))
    high = F.least(F.col("start") + i, F.col("start") + F.col("more") + (d - i), F.col("n") - F.col("size"))
    asked = asked.withColumns({"low": low, "high": high}).where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    keys = ["m", "d", "i", "part"]
    asked = asked.select("a", "of_a", "m", "d", "i", F.substring(F.col("a"), F.col("at") + 1, F.col("size")).alias("part"))
    asked = asked.repartition(8 * left.sparkSession.sparkContext.defaultParallelism, *keys)  # few bytes, much work: not to be merged into few tasks
    x, y = asked.alias("x"), parts.alias("y")
    may = F.bit_count(F.col("of_a").bitwiseXOR(F.col("of_b"))) <= 2 * F.col("x.d")
    meet = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    verified = F.when(may, similarity(F.col("a"), F.col("b")) >= least - 1e-12).otherwise(False)  # the dear test only where the cheap one holds
    return x.join(y, meet[0] & meet[1] & meet[2] & meet[3] & verified).select("a", "b").distinct()


def bigram_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): candidates for the similarity, over bigrams; none is lost.

    Edits change two bigrams each, so names of n and m letters that similar share at least 1 + (2 least - 1) max(n, m) bigrams. A pair then shares one of the rarest
    few of each side, in one order of rarity for both: only those meet, within the lengths that the similarity allows.
    """
    spread = lambda df, c: df.select(c, F.explode(bigrams(F.col(c))).alias("gram"))
    lg, rg = spread(left, "a"), spread(right, "b")
    count = lg.select("gram").unionByName(rg.select("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        w = Window.partitionBy(c).orderBy("n", "gram")  # the bigrams of one name
        shared = F.ceil(1 + F.lit(2 * least - 1) * F.length(c) - 1e-9)
        return df.join(count, "gram").withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.length(c) + 1 - shared + 1).select(c, "gram", F.length(c).alias(f"n{c}"))

    near = (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9)
    return rare(lg, "a").join(rare(rg, "b"), "gram").where(near).select("a", "b").distinct()


def _settled(found: DataFrame, most: int, edits: int, least: float) -> DataFrame:
    """(a): the names whose best `most` are found, as none that they have not met can be as similar."""
    ahead = F.element_at(F.array(*[F.lit(_ahead(n, edits, least)) for n in range(1, _reach(least) + 1)]), F.length("a"))
    last = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"))) == most
    return found.withColumn("last", last).where(F.col("last") & (F.col("similarity") > ahead + 1e-12)).select("a")


def _similar(names: DataFrame, known: DataFrame, name: str, other: str, least: float, most: int | None = None) -> DataFrame:
    """(name, other, similarity) of all similar pairs; with `most` of at least those that can be among a name's best `most`, of which none is equal to it: names that have them are not asked again with more edits."""
    if not 0.5 < least <= 1:
        raise ValueError("the similarity must be over one half")
    text = lambda df, c, to: df.select(F.col(c).alias(to)).where(F.length(to) > 0).distinct()
    left, right = written(text(names, name, "a"), "names"), written(text(known, other, "b"), "known")
    found = []
    for edits in range(1 if most else 0, EDITS + 1):
        pairs = rest_pairs(left, right, edits, least)
        if pairs is not None:
            found.append(written(pairs, "pairs"))
            if most:
                left = written(left.join(_settled(reduce(DataFrame.unionByName, found), most, edits, least), "a", "left_anti"), "names")
    pairs = segment_pairs(left.where(F.length("a") <= LONG), right, least, _reach(least))
    long = left.where(F.length("a") > LONG)
    if not long.isEmpty():
        pairs = pairs.unionByName(bigram_pairs(long, right.where(F.length("b") >= least * LONG), least))
    found.append(pairs.withColumn("similarity", similarity(F.col("a"), F.col("b"))).where(F.col("similarity") >= least - 1e-12))
    return reduce(DataFrame.unionByName, found).select(F.col("a").alias(name), F.col("b").alias(other), "similarity")


def similar_names(names: DataFrame, known: DataFrame, name: str, other: str, least: float) -> DataFrame:
    """(name, other, similarity) of all pairs with at least this similarity (over one half), every pair verified. Null and empty names have no partners; repeated names count once."""
    return _similar(names, known, name, other, least)


def suggestions(names: DataFrame, known: DataFrame, name: str, other: str, least: float = 0.75, most: int = 3) -> DataFrame:
    """(name, other, similarity, rank): the best `most` known names of each unresolved one; ties by the known name. Names that are known need none and are left out."""
    known = written(known.select(other), "known-names")
    open_names = names.join(known.select(F.col(other).alias(name)), name, "left_anti")
    best = Window.partitionBy(name).orderBy(F.desc("similarity"), other)
    return _similar(open_names, known, name, other, least, most).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= most)
