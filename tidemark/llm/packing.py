"""Order-preserving packing of token streams into windows.

Documents are dealt into ranges of ascending id and tokenized; within a range their ids, each document ending in `end_id`, form one stream.
Windows of at most `window` tokens are cut by dynamic programming over the document and sentence ends of the stream: the cost of a window is
its padding (none at a power of two) plus a penalty if its end cuts a document at a sentence end. As a window's padding is
window - (p - q), the best earlier cut q is the least cost[q] + q among the cuts within reach, which a monotone queue keeps at its head; the
powers of two are tried besides. Only where no end lies within reach of the one before is a document cut inside a sentence. The last window
of a range is split into powers of two where that costs less than its padding.

The stream is planned in steps of at least `step_tokens`, carrying the last window's documents into the next step, so memory does not
grow with a range. A null text counts as empty and still has its end token. Rows without an id come first; equal ids stay separate
documents, in order of a hash of the text, and may fall into several ranges. A text of any length is tokenized in parts, but its ids are held
together in one task until they are in windows (4 bytes a token).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.words import TOGETHER, distinct, fold, in_parts

WINDOW = 4096
SENTENCE_CUT, INNER_CUT = 8, 64
STEP_TOKENS = 1 << 20
#: Bytes of text of one range.
RANGE_BYTES = 8 << 20
BLANKS = b" \n"
FOLD = fold(BLANKS)


#: ASCII marks that no contraction starts with. Behind a letter or digit and up to the word's end they are a token group of their own.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _closed(core: bytes) -> bool:
    """The last character is an ASCII letter or digit or a Latin letter that stays one in lower case, so marks behind it start a group."""
    if core[-1] < 128:
        return core[-1:].isalnum()
    c = core[-4:].decode(errors="ignore")[-1:]
    return "\u00c0" <= c <= "\u024f" and c.isalpha() and len(c.lower()) == 1


class WordTokens:
    """Token ids by a cache of the words between blanks and line ends, which a tokenizer that drops white space never joins.

    Each distinct word of a batch is looked up once. Words are kept in two generations of at most about `most` each. A new word that ends in
    marks is put together from its parts; new words of a-z go straight to the tokenizer's model, which its other steps would hand them to
    unchanged; new words of letters are encoded some at a time, for each ends in a token that closes a word; others one by one. A text with
    the opening of a special token's name is encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.young, self.old = {b"": b""}, {}
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        #: Which ids are a sentence's closing mark.
        self.sentence_ends = np.zeros(len(self.closes), bool)
        self.sentence_ends[[i for t, i in vocab.items() if (w := t.removesuffix("</w>")) != t and w and not w.strip(".!?")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        # one call for each some texts; the batch call leaves out character places, which nothing here needs
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], together: int = 64) -> None:
        young, tokenize = self.young, self.tokenizer.model.tokenize
        plain = [w for w in words if w.isalpha()]
        ids, ends = [], []
        for w in plain:
            ids += [t.id for t in tokenize(w.decode())]
            ends.append(len(ids))
        raw = np.array(ids, "<u4").tobytes()
        young.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(plain, [0, *ends], ends))
        letters, others = [], []
        for w in words:
            if not w.isalpha():
                (letters if (t := w.decode()).isalpha() else others).append(t)
        groups = [letters[i : i + together] for i in range(0, len(letters), together)]
        for group, raw in zip(groups, self._whole([" ".join(g) for g in groups])):
            ends = (4 * np.nonzero(self.closes[np.frombuffer(raw, "<u4")])[0] + 4).tolist()
            if len(ends) == len(group):
                for t, a, b in zip(group, [0, *ends], ends):
                    young[t.encode()] = raw[a:b]
            else:
                others += group
        for t, raw in zip(others, self._whole(others)):
            young[t.encode()] = raw

    def _meet(self, words: set[bytes]) -> None:
        """Make all these words, none of them young, known."""
        young, old = self.young, self.old
        fresh, joined = set(), []
        for w in words:
            if w in old:
                young[w] = old[w]
            elif 0 < len(core := w.rstrip(MARKS)) < len(w) and _closed(core):
                joined.append((w, core))
            else:
                fresh.add(w)
        for x in {x for w, core in joined for x in (core, w[len(core) :])}:
            if x not in young:
                if x in old:
                    young[x] = old[x]
                else:
                    fresh.add(x)
        self._learn(list(fresh))
        for w, core in joined:
            young[w] = young[core] + young[w[len(core) :]]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary, no nulls) behind each other, `end_id` after each text, and where each text ends."""
        if len(self.young) > self.most:
            self.young, self.old = {b"": b""}, self.young
        codes, names, ends = distinct(texts, FOLD, b"<|")
        found = list(map(self.young.get, names))
        gaps = [k for k, x in enumerate(found) if x is None]
        special = [k for k in gaps if b"<|" in names[k]]
        for k, ids in zip(special, self._whole([names[k].decode() for k in special])):
            found[k] = ids
        gaps = [k for k in gaps if found[k] is None] if special else gaps
        self._meet({names[k] for k in gaps})
        for k in gaps:
            found[k] = self.young[names[k]]
        pool = np.append(np.frombuffer(b"".join(found), "<u4"), np.uint32(end_id))
        size = np.append(np.fromiter(map(len, found), "i8", len(found)) // 4, 1)
        stream = np.insert(codes, ends, len(found))
        n = size[stream]
        after = np.cumsum(n)
        ids = pool[np.repeat((np.cumsum(size) - size)[stream] - after + n, n) + np.arange(after[-1] if len(after) else 0)]
        return ids, after[ends + np.arange(len(ends))]

    def encode_in_parts(self, texts: pa.Array, end_id: int, together: int = TOGETHER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, one after the last, ids, ends) for some rows after each other; the ids of a long text are put together from its parts."""
        for lo, hi, parts in in_parts(texts, BLANKS, together):
            if len(parts) == 1:
                yield lo, hi, *self.encode(parts[0], end_id)
                continue
            text = texts[lo].as_py()
            if b"<|" in text:
                ids = [np.frombuffer(self._whole([text.decode()])[0], "<u4")]
            else:
                ids = [self.encode(part, end_id)[0][:-1] for part in parts]
            ids = np.append(np.concatenate(ids), np.uint32(end_id))
            yield lo, hi, ids, np.array([len(ids)])


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The worker's cache for this vocabulary; it lives as long as the worker."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def cuts(ends: np.ndarray, inner: np.ndarray, total: int, window: int = WINDOW) -> list[int]:
    """Ends of the windows over a stream of `total` tokens. ends: ends of documents, inner: ends of sentences."""
    if not total:
        return []
    marked, free = np.zeros((2, total + 1), bool)
    free[ends] = free[total] = True
    marked[inner] = marked[ends] = marked[total] = True
    marked[0] = False
    marks = np.nonzero(marked)[0]
    gaps = np.diff(marks, prepend=0)
    fill = (gaps - 1) // window  # where no mark lies within reach, a document is cut every window
    pos = np.repeat(marks, fill + 1)
    back = np.repeat(np.cumsum(fill + 1), fill + 1) - 1 - np.arange(len(pos))
    pos = np.where(back > 0, np.repeat(marks - gaps, fill + 1) + (np.repeat(fill, fill + 1) - back + 1) * window, pos)
    penalties = np.where(back > 0, INNER_CUT, np.where(free[pos], 0, SENTENCE_CUT)).tolist()
    pos = np.append(0, pos)
    exact: dict[int, list[int]] = {}
    for s in (1 << k for k in range(8, window.bit_length()) if 1 << k < window):
        k = np.searchsorted(pos, pos - s)
        for j in np.nonzero(pos[k] == pos - s)[0].tolist():
            exact.setdefault(j, []).append(int(k[j]))
    pos = pos.tolist()
    #: key: the least cost up to a cut plus its place, by which earlier cuts within reach compare.
    key, before, queue, head = [0], [0], [0], 0
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[head]] < p - window:
            head += 1
        i = queue[head]
        c = key[i] + window - p
        for k in exact.get(j, ()):
            if key[k] - pos[k] < c:
                c, i = key[k] - pos[k], k
        c += penalties[j - 1] + p
        before.append(i)
        key.append(c)
        while len(queue) > head and key[queue[-1]] >= c:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = before[j]
    return out[::-1]


def last_cuts(first: int, end: int, window: int = WINDOW) -> list[int]:
    """The last window in powers of two if the cuts cost less than its padding."""
    n = end - first
    powers = [1 << k for k in range(window.bit_length() - 1, -1, -1) if n >> k & 1]
    if (len(powers) - 1) * INNER_CUT >= (window - n if n & (n - 1) else 0):
        return [end]
    return [int(x) for x in first + np.cumsum(powers)]


class _Stream:
    """The documents of one range that are not yet in windows: ids, and for each the tokens before, the tokens here and the tokens in all."""

    def __init__(self, is_end: np.ndarray, window: int, first_sequence: int):
        self.is_end, self.window, self.sequence = is_end, window, first_sequence
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        n = np.diff(ends, prepend=0)
        self.held.append((doc_ids, ids, np.zeros(len(n), "i8"), n, n))
        self.tokens += len(ids)

    def flush(self, final: bool) -> list[pa.Array]:
        """Columns of the pieces of all windows but the last, which waits for more documents unless this is final."""
        if not self.held:
            return [pa.array([], pa.int64())] * 7
        parts = list(zip(*self.held))
        doc_ids = pa.concat_arrays(parts[0])
        ids, before, here, total = map(np.concatenate, parts[1:])
        ends = np.cumsum(here)
        at = cuts(ends, np.nonzero(self.is_end[ids])[0] + 1, len(ids), self.window)
        at = at[:-1] + (last_cuts(at[-2] if len(at) > 1 else 0, len(ids), self.window) if final else [])
        done = at[-1] if at else 0
        at = np.array(at, "i8")
        stop = np.union1d(at, ends[ends <= done])
        start = np.append(0, stop[:-1]) if len(stop) else stop
        doc, sequence = np.searchsorted(ends, start, "right"), np.searchsorted(at, start, "right")
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist())]
        columns = [doc_ids.take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (
            before[doc] + start - (ends - here)[doc], stop - start, crc, total[doc], self.sequence + sequence, start - np.append(0, at)[sequence]
        ))]
        self.sequence += len(at)
        k = int(np.searchsorted(ends, done, "right"))
        self.held, self.tokens = [], len(ids) - done
        if k < len(ends):
            cut = done - int(ends[k] - here[k])
            before, here = before[k:].copy(), here[k:].copy()
            before[0] += cut
            here[0] -= cut
            self.held = [(doc_ids.slice(k), ids[done:].copy(), before, here, total[k:])]
        return columns


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window < 1:
        raise ValueError("a window holds at least one token")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        stream = _Stream(words.sentence_ends, window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
            for lo, hi, ids, ends in words.encode_in_parts(texts, end_id):
                stream.add(doc_ids.slice(lo, hi - lo), ids, ends)
                if stream.tokens >= step_tokens:
                    yield pa.RecordBatch.from_arrays(stream.flush(False), names=names)
        yield pa.RecordBatch.from_arrays(stream.flush(True), names=names)

    lot = F.xxhash64("text")  # a repeated id, or many rows without one, may fill several ranges
    ordered = docs.withColumn("lot", lot).repartitionByRange(max(1, -(-size // range_bytes)), "doc_id", "lot").sortWithinPartitions("doc_id", "lot", "text").drop("lot")
    return map_batches(ordered, run, ", ".join(f"{n} long" for n in names))
