"""Phrase collocations by external streams of counts: sorted in prefix order, merge-joined in prefix and in suffix order.

Every place of a text gives one window: its language and the words from there to the end of the piece, five at most. Windows are added up
within a batch, sorted by range, and read once in order: the count of every shorter phrase is the sum over the run of windows that begin
with it, so one sorted stream holds the counts of all lengths, and no table of counts is kept in memory. What occurs often enough is then
kept by length. Each length is joined with the next shorter one twice by sort-merge joins, in prefix order (without its last word) and in
suffix order (without its first word): that gives the counts left and right of every cut, and the most frequent extension of each phrase.

The most frequent words of all (TABLE of them, whatever the size of the input) stand in a key as one to three bytes, other words are spelled.
Where the table holds every word that occurs often enough, a window ends before any other word, which no phrase of the result can hold.

Defined results: a text that is null or holds no words gives nothing; a null language is `und`; a repeated row counts again; very long
texts are read in parts, windows reach over the parts' ends; an empty table gives no rows; other columns of the table are not read, whatever
their names. Ties of a score go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import map_batches, materialise
from tidemark.llm.words import offsets

LONGEST, LEAST, SHARE, TOP = 5, 100, 100, 2000
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: About how many bytes of text are counted together.
TOGETHER = 4 << 20
#: Bytes of text to one range of the sorted stream.
RANGE_BYTES = 48 << 20
#: Stands between the words of a phrase, and ends a language or a spelled word in a key; no word holds it.
SEP = b"\t"
#: Bytes up to this one are spelled as this byte and a printable one.
ESCAPE = 10
#: Ends the words of a key whose count is not 1; the count follows.
TIMES = b"\x01"
#: Words with codes: ONE of one byte, TWO of two, the others of three; none of them longer than SHORT bytes.
ONE, TWO, SHORT = 126, 64 * 256, 64
TABLE = 1 << 18

_KIND = np.zeros(256, "u1")
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
_LOW = np.arange(256, dtype="u1")
_LOW[65:91] += 32


def _escaped(words: pa.Array) -> pa.Array:
    at, held = offsets(words), words.buffers()[2]
    if held is None or not (np.frombuffer(held, "u1")[at[0] : at[-1]] <= ESCAPE).any():
        return words
    return pa.array([b"".join(bytes((ESCAPE, b + 48)) if b <= ESCAPE else bytes((b,)) for b in w) for w in words.to_pylist()], pa.binary())


def unescaped(column):
    for b in range(ESCAPE + 1):  # the escape byte itself comes last
        column = F.replace(column, F.lit(chr(ESCAPE) + chr(b + 48)), F.lit(chr(b)))
    return column


class Table:
    """Codes of frequent words: a byte from 2 to 127, or one from 128 and another, or one from 192 and two; byte 0 begins a spelled word. complete: no other word is frequent."""

    def __init__(self, words: list[bytes], complete: bool):
        self.words, self.complete = pa.array(words, pa.binary()), complete
        codes = [bytes((k + 2,)) for k in range(min(ONE, len(words)))]
        codes += [(k + (128 << 8)).to_bytes(2) for k in range(min(TWO, len(words) - len(codes)))]
        self.codes = pa.array(codes + [(k + (192 << 16)).to_bytes(3) for k in range(len(words) - len(codes))], pa.binary())

    def keys(self, names: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words' keys, and which of them end a window."""
        place = pc.index_in(names, self.words)
        coded, other = self.codes.take(place), place.is_null().to_numpy(zero_copy_only=False)
        if self.complete or not other.any():
            return pc.fill_null(coded, b""), other
        spelled = pc.binary_join_element_wise(pa.scalar(b"\0"), _escaped(names), pa.scalar(SEP), pa.scalar(b""))
        return pc.if_else(pa.array(other), spelled, coded), np.zeros(len(names), bool)

    def phrase(self, key: bytes) -> bytes:
        """Language and words of a key without count, parted by SEP."""
        at = key.index(SEP)
        out = [key[:at]]
        at += 1
        while at < len(key):
            if first := key[at]:
                size, base = (1, -2) if first < 128 else (2, ONE - (128 << 8)) if first < 192 else (3, ONE + TWO - (192 << 16))
                word = self.words.slice(int.from_bytes(key[at : at + size]) + base, 1)
                out.append(_escaped(word)[0].as_py())
                at += size
            else:
                end = key.index(SEP, at)
                out.append(key[at + 1 : end])
                at = end + 1
        return SEP.join(out)


def split_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(where each word starts, the words) of texts that lie in `raw` at the offsets `at`."""
    word = _KIND[raw] == 0
    starts = np.zeros(len(raw), bool)
    starts[1:] = word[1:] & ~word[:-1]
    begin = at[:-1][at[:-1] < len(raw)]
    starts[begin] = word[begin]
    starts = np.nonzero(starts)[0]
    length = np.cumsum(word, dtype="i4")
    lies = np.append(length[starts] - 1, length[-1:]).astype("i4") if len(starts) else np.zeros(1, "i4")
    return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(lies), pa.py_buffer(_LOW[raw[word]])]).dictionary_encode()


def windows(raw: np.ndarray, at: np.ndarray, langs: pa.Array, longest: int, table: Table, upto: int | None = None) -> pa.Array:
    """Keys in order, with counts, of the windows in texts that lie in `raw` at the offsets `at`. upto: only windows that start before it."""
    starts, coded = split_words(raw, at)
    if not len(starts):
        return pa.array([], pa.binary())
    keys, ending = table.keys(coded.dictionary)
    order = pc.array_sort_indices(keys).to_numpy()
    place = np.empty(len(order), "i4")
    place[order] = np.arange(1, len(order) + 1)
    place[ending] = 0
    names, codes = keys.take(pa.array(order)), place[coded.indices.to_numpy()]
    doc = (np.searchsorted(at, starts, "right") - 1).astype("i4")
    ends = np.cumsum(_KIND[raw] == 2, dtype="i4")[starts]
    follows = np.zeros(len(starts) + longest, bool)
    follows[: len(starts) - 1] = (ends[1:] == ends[:-1]) & (doc[1:] == doc[:-1])
    n = len(starts) if upto is None else int(np.searchsorted(starts, upto))
    spoken = langs.dictionary_encode()
    lang_keys = pc.binary_join_element_wise(_escaped(spoken.dictionary), pa.scalar(b""), pa.scalar(SEP))
    columns, bits = [spoken.indices.to_numpy()[doc[:n]]], [int(len(lang_keys)).bit_length()]
    reach, held = np.ones(n, bool), np.append(codes, np.zeros(longest, "i4"))
    for k in range(longest):
        columns.append(np.where(reach, held[k : k + n], 0))
        bits.append(int(len(names)).bit_length())
        reach = follows[k : k + n] & (columns[-1] > 0)
    packed, room = [], 0
    for c, b in zip(columns, bits):
        if packed and b <= room:
            packed[-1] = packed[-1] << b | c
            room -= b
        else:
            packed.append(c.astype("i8"))
            room = 63 - b
    order = np.lexsort(packed[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for p in packed:
        p = p[order]
        new[1:] |= p[1:] != p[:-1]
    first = np.nonzero(new)[0]
    row = order[first]
    parts = [lang_keys.take(pa.array(columns[0][row]))]
    for c in columns[1:]:
        c = c[row]
        parts.append(names.take(pa.array(c - 1, mask=c == 0)))
    counts, which = np.unique(np.diff(first, append=n), return_inverse=True)
    times = pa.array([TIMES + c.to_bytes((c.bit_length() + 7) // 8) if c > 1 else None for c in counts.tolist()], pa.binary())
    return pc.binary_join_element_wise(*parts, times.take(pa.array(which)), b"", null_handling="skip")


def _after_blank(raw: np.ndarray, at: int, step: int) -> int:
    """One after the first blank or end of a piece that does not lie before `at`, or the end."""
    while at < len(raw):
        hit = np.nonzero(_KIND[raw[at : at + step]])[0]
        if len(hit):
            return at + int(hit[0]) + 1
        at += step
    return len(raw)


def _parts(texts: pa.Array, more: int, together: int = TOGETHER) -> Iterator[tuple[int, np.ndarray, np.ndarray, int | None]]:
    """(first row, bytes, offsets of texts, None) of some texts together, or of a long text in parts, with `more` words after each and where the next begins."""
    at, lo = offsets(texts).astype("i8"), 0
    held = np.frombuffer(texts.buffers()[2] or b"", "u1")
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + together, "right")) - 1)
        raw = held[at[lo] : at[hi]]
        if hi > lo + 1 or len(raw) <= 2 * together:
            yield lo, raw, at[lo : hi + 1] - at[lo], None
        else:
            a = 0
            while a < len(raw):
                b = e = _after_blank(raw, a + together, 4096)
                for _ in range(more):
                    while e < len(raw) and _KIND[raw[e]]:
                        e += 1
                    e = _after_blank(raw, e, 64)
                yield lo, raw[a:e], np.array([0, e - a]), b - a
                a = b
        lo = hi


class _Runs:
    """Sums over the runs of a sorted stream of keys, one for each number of words; what may go on in a neighbouring range is always told."""

    def __init__(self, longest: int, least: int):
        self.levels, self.least = longest + 1, least
        self.last, self.carry = None, np.zeros(self.levels, "i8")
        self.at_start = np.ones(self.levels, bool)
        self.open: list[bytes] = []

    def add(self, keys: pa.Array) -> tuple[list[bytes], list[int], list[int]]:
        """keys: with counts, none of them null."""
        first_key = int(self.last is None)
        if self.last is not None:
            keys = pa.concat_arrays([pa.array([self.last], pa.binary()), keys])
        at, n = offsets(keys).astype("i8"), len(keys)
        raw = np.frombuffer(keys.buffers()[2], "u1")[at[0] : at[-1]]
        at = at - at[0]
        tabs = np.nonzero(raw == SEP[0])[0]
        start, end = np.zeros((n, self.levels + 1), "i8"), np.zeros((n, self.levels + 1), "i8")
        start[:, 0], stop = at[:-1], at[1:]
        end[:, 0] = tabs[np.searchsorted(tabs, start[:, 0])] + 1
        padded = np.append(raw, TIMES[0])
        for j in range(1, self.levels):
            a = start[:, j] = end[:, j - 1]
            first = padded[a]
            size = 1 + (first >= 128) + (first >= 192)
            spelled = np.nonzero((first == 0) & (a < stop))[0]
            size[spelled] = tabs[np.searchsorted(tabs, a[spelled])] + 1 - a[spelled]
            end[:, j] = np.where((a < stop) & (first != TIMES[0]), a + size, a)
        words_end = start[:, -1] = end[:, -2]
        end[:, -1] = stop
        counts, places = np.ones(n, "i8"), stop - words_end - 1
        for k in range(int(places.max(initial=0))):
            more = places > k
            counts[more] = (counts[more] << 8 if k else 0) | raw[words_end[more] + 1 + k]
        counts[: 1 - first_key] = 0  # the last key of before
        real = end > start
        cut = np.append(start[real], len(raw)).astype("i4")
        word = np.full((n, self.levels + 1), -1)
        word[real] = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(raw)]).dictionary_encode().indices.to_numpy()
        word = word[:, :-1]
        same = np.zeros((n, self.levels), bool)
        same[1:] = np.logical_and.accumulate((word[1:] == word[:-1]) & (word[1:] >= 0), axis=1)
        total = np.append(0, np.cumsum(counts))
        held = keys.buffers()[2].to_pybytes()[int(offsets(keys)[0]) :] if n else b""
        out: tuple[list[bytes], list[int], list[int]] = ([], [], [])
        for j in range(self.levels):
            starts = np.nonzero(~same[:, j])[0]
            sums = np.diff(total[np.append(starts, n)])
            sums[0] += self.carry[j]
            told = (word[starts, j] >= 0) & (sums >= self.least)
            told[-1] = False  # still open
            if self.at_start[j] and len(starts) > 1:
                told[0], self.at_start[j] = word[0, j] >= 0, False
            for k in np.nonzero(told)[0].tolist():
                i = int(starts[k])
                out[0].append(held[at[i] : end[i, j]])
                out[1].append(j)
                out[2].append(int(sums[k]))
            self.carry[j] = sums[-1] if word[n - 1, j] >= 0 else 0
        self.last = held[at[n - 1] : words_end[n - 1]]
        self.open = [held[at[n - 1] : end[n - 1, j]] for j in range(self.levels) if real[n - 1, j]]
        return out

    def close(self) -> tuple[list[bytes], list[int], list[int]]:
        if self.last is None:
            return [], [], []
        return self.open, list(range(len(self.open))), [int(x) for x in self.carry[: len(self.open)]]


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", range_bytes: int = RANGE_BYTES, coded: int = TABLE) -> DataFrame:
    """(key, words, f): every phrase of up to `longest` words that occurs `least` times in a language, and, with 0 words, each language's words in all."""
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).cast("binary").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("bytes"))

    table = frequent_words(docs, least, coded)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw, at, upto in _parts(batch.column("text"), longest):
                yield pa.RecordBatch.from_arrays([windows(raw, at, batch.column("lang").slice(row, len(at) - 1), longest, table, upto)], names=["key"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(longest, least)
        told = lambda x: pa.RecordBatch.from_arrays([pa.array([table.phrase(k) for k in x[0]], pa.binary()), pa.array(x[1], pa.int32()), pa.array(x[2], pa.int64())], names=["key", "words", "c"])
        for batch in batches:
            if batch.num_rows:
                yield told(runs.add(batch.column("key")))
        yield told(runs.close())

    size = docs.agg(F.coalesce(F.sum(F.col("bytes").cast("long")), F.lit(0))).first()[0]
    stream = map_batches(docs.select("lang", "text"), count, "key binary")  # made twice, as ranges are drawn first: cheaper than a copy on disk
    ordered = stream.repartitionByRange(max(1, -(-size // range_bytes)), "key").sortWithinPartitions("key")
    sums = map_batches(ordered, add, "key binary, words int, c long").groupBy("key", "words").agg(F.sum("c").alias("f"))
    return materialise(sums.where((F.col("f") >= least) | (F.col("words") == 0)).select(F.col("key").cast("string").alias("key"), "words", "f"), "frequent")


def frequent_words(docs: DataFrame, least: int, most: int = TABLE) -> Table:
    """The `most` words that occur most often in all languages together, at least `least` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, at, _ in _parts(batch.column("text"), 0):
                coded = split_words(raw, at)[1]
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(counts, pa.int64())], names=["word", "c"])

    words = materialise(map_batches(docs.select("text"), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where(F.col("c") >= least), "words")
    short = words.where(F.octet_length("word") <= SHORT).orderBy(F.desc("c"), "word").limit(most).collect()
    return Table([bytes(r["word"]) for r in short], words.count() <= len(short))


def _by_length(counts: DataFrame, longest: int) -> dict[int, DataFrame]:
    """By number of words: key, f, head (without the last word), tail (without the first) and the counts left and right of each cut."""
    tab, none = SEP.decode(), F.array().cast("array<long>")
    out = {1: counts.where("words = 1").select("key", "f", none.alias("lefts"), none.alias("rights"))}
    for m in range(2, longest + 1):
        tail = F.concat_ws(tab, F.substring_index("key", tab, 1), F.substring_index("key", tab, 1 - m))
        now = counts.where(F.col("words") == m).select("key", "f", F.substring_index("key", tab, m).alias("head"), tail.alias("tail"))
        in_prefix_order = out[m - 1].select(F.col("key").alias("head"), F.concat("lefts", F.array("f")).alias("lefts"))
        in_suffix_order = out[m - 1].select(F.col("key").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
        out[m] = materialise(now.join(in_prefix_order.hint("merge"), "head").join(in_suffix_order.hint("merge"), "tail"), f"phrases-{m}")
    return out


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """Every phrase of 2 to `longest` words that occurs `least` times and in no longer such phrase `share` percent as often: lang, phrase, a, l, r, n, score, cut."""
    tab = SEP.decode()
    counts = frequent(docs, longest, least, text_col, lang_col, **sizes)
    lengths = _by_length(counts, longest)
    columns = ["key", "f", "lefts", "rights"]
    phrases = lengths[2].select(*columns)
    longer = lengths[2].select("key", "f").limit(0)
    for m in range(3, longest + 1):
        phrases = phrases.unionByName(lengths[m].select(*columns))
        longer = longer.unionByName(lengths[m].select(F.col("head").alias("key"), "f")).unionByName(lengths[m].select(F.col("tail").alias("key"), "f"))
    # The most frequent longer phrase that holds a phrase is one word longer: any longer one holds such a one, which is no rarer.
    kept = phrases.join(longer.groupBy("key").agg(F.max("f").alias("extension")).hint("merge"), "key", "left").where(f"extension is null or 100 * extension < {share} * f")
    totals = counts.where("words = 0").select(F.col("key").alias("code"), F.col("f").alias("n"))
    cut = F.expr("""array_min(transform(lefts, (l, i) -> named_struct('score', (cast(1000 as decimal(38, 0)) * f * n) div (cast(l as decimal(38, 0)) * rights[i]), 'k', i + 1, 'l', l, 'r', rights[i])))""")
    phrase = F.translate(F.expr("substring(key, length(code) + 2)"), tab, " ")
    return (
        kept.withColumn("code", F.substring_index("key", tab, 1)).join(totals, "code").withColumn("cut", cut)
        .select(unescaped(F.col("code")).alias("lang"), unescaped(phrase).alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score", F.col("cut.k").alias("cut"))
    )


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, count and phrase, with their rank; a large language is first cut down in parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    within = phrases.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).drop("part")
