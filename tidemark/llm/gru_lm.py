"""Document log-likelihoods by a gated recurrent language model.

Tokens are the words between ASCII white space with A-Z in lower case, then one end a document. All training documents are counted; the
most frequent words, the end, and kinds of other words (by their last bytes) form the model's vocabulary, cut by frequency into classes of
equal size: P(token) = P(class) P(token in class), and for a word outside the vocabulary times (c + 1) / (N + V + 1) within its kind (c its
count, N and V the tokens and words of the kind in training, 1 for all unseen words).

The GRU starts at the unigram distribution and is trained on every training document: in each round each task reads its share of the
documents in lanes by truncated backpropagation, the state being carried through all windows of a document and each of them updating
the weights, and the tasks' weights are averaged by tokens, some tasks at a time. What is counted and trained on grows with the input; only
the weights and the most frequent words, both of fixed size, come to the driver. Scoring carries the state through the whole document. Lanes
are filled a window at a time, so a text of any length takes its ids (4 bytes a word) and one window of a lane. Counts of rarer words are
joined, not broadcast.

Null texts count as empty: one end. Rows without an id are learnt from unless the caller says otherwise; repeated rows count repeatedly. With
no training documents all counts are zero, and the score is that of a model of unseen words.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, materialise
from tidemark.llm.words import distinct, fold, in_parts

#: Classes and tokens in each; kinds of other words; words whose counts every task holds.
CLASSES, PER_CLASS, KINDS, KNOWN = 64, 64, 128, 65_536
EMBED, HIDDEN = 16, 32
LANES, STEPS, RATE, ROUNDS = 128, 32, 8e-3, 2
#: Lanes and steps of a window when scoring.
SCORE_LANES, SCORE_STEPS = 512, 32
#: Tasks whose weights are added up together before all are, and weights that travel in one row.
TASKS_TOGETHER, PIECE = 64, 1 << 13
END = b"\n"  # no word holds it
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
FOLD = fold(BLANKS)
FLUSH = 300_000


def kind(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % KINDS


def _texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"")


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, kind, c) over all rows; the end of a document is no row here. Tasks add up before the shuffle, a bounded table at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            c.pop(b"", None)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array([kind(w) for w in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "kind", "c"])

        c: defaultdict[bytes, int] = defaultdict(int)
        for batch in batches:
            for _, _, parts in in_parts(_texts(batch, text_col), BLANKS):
                for part in parts:
                    codes, names, _ = distinct(part, FOLD)
                    for w, n in zip(names, np.bincount(codes, minlength=len(names)).tolist()):
                        c[w] += n
                    if len(c) >= FLUSH:
                        yield out()
                        c = defaultdict(int)
        yield out()

    parts = map_batches(docs.select(text_col), run, "word string, kind int, c long")
    return parts.groupBy("word", "kind").agg(F.sum("c").alias("c"))


class Vocabulary:
    """ids of the model's tokens, the counts of the known words, and the constants of the unigram model."""

    def __init__(self, known: list[tuple[bytes, int]], kinds: dict[int, tuple[int, int]], documents: int, tokens: int, types: int):
        self.documents, self.tokens, self.types = documents, tokens + documents, types + (documents > 0)
        slots = CLASSES * PER_CLASS
        kept = known[: slots - KINDS - 1]
        entries = [(w, c) for w, c in kept] + [(END, documents)]
        n, v = np.zeros(KINDS), np.zeros(KINDS)
        for k, (a, b) in kinds.items():
            n[k], v[k] = a, b
        for w, c in kept:  # a kind holds what is outside the vocabulary
            n[kind(w)] -= c
            v[kind(w)] -= 1
        self.kind_log = -np.log10(n + v + 1)
        entries += [(k, n[k]) for k in range(KINDS)]
        entries.sort(key=lambda e: (-e[1], str(e[0])))
        ids = {w: i for i, (w, _) in enumerate(entries)}
        self.end = ids[END]
        self.kind_id = np.array([ids[k] for k in range(KINDS)], "i4")
        self.counts = np.array([c for _, c in entries] + [0] * (slots - len(entries)), float)
        #: Place of each known word in the three arrays: its model id, log10(c + 1), and log10 of its share in its kind if it is outside the vocabulary.
        self.known = {w: i for i, (w, _) in enumerate(known)}
        self.known_id = np.array([ids[w] if w in ids else self.kind_id[kind(w)] for w, _ in known], "i4")
        self.known_log = np.log10(np.array([c for _, c in known], float) + 1)
        self.known_share = np.array([0.0 if w in ids else self.known_log[i] + self.kind_log[kind(w)] for i, (w, _) in enumerate(known)])

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The model ids of each text with the end."""
        for _, _, parts in in_parts(texts, BLANKS):
            read = [self._stream(part)[:2] for part in parts]
            if len(read) > 1:
                yield np.concatenate([*(ids[:-1] for ids, _ in read), read[-1][0][-1:]])
            else:
                yield from np.split(read[0][0], read[0][1][:-1])

    def read(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict[bytes, int]]]]:
        """For rows first to last (binary, no nulls): model ids with the ends, where each text ends, log10(c + 1) over its known words, log10
        of its shares within kinds (less log10(c + 1) of words not known), and those words with their numbers."""
        for lo, hi, parts in in_parts(texts, BLANKS):
            read = [self._read(part) for part in parts]
            if len(read) > 1:
                tail: Counter = Counter()
                for r in read:
                    tail.update(r[4][0])
                ids = np.concatenate([*(r[0][:-1] for r in read), read[-1][0][-1:]])
                read = [(ids, np.array([len(ids)]), sum(r[2] for r in read), sum(r[3] for r in read), [tail])]
            yield lo, hi, *read[0]

    def _stream(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Ids with the ends, where texts end, and each word's text, code, and by code the name, its place among the known (-1: none) and its kind."""
        codes, names, ends = distinct(texts, FOLD)
        at = np.fromiter(map(self.known.get, names, repeat(-1)), "i8", len(names))
        kinds = np.fromiter(map(kind, names), "i4", len(names))
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        if b"" in names:
            kept = np.fromiter(map(len, names), "i8", len(names))[codes] > 0
            codes, doc = codes[kept], doc[kept]
            ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        ids = np.append(np.where(at < 0, self.kind_id[kinds], self.known_id[at] if len(self.known) else 0), self.end).astype("i4")
        return ids[np.insert(codes, ends, len(names))], ends + np.arange(1, len(texts) + 1), doc, codes, names, at, kinds

    def _read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[dict[bytes, int]]]:
        stream, ends, doc, codes, names, at, kinds = self._stream(texts)
        n, new = len(texts), at < 0
        logs = np.where(new, 0.0, self.known_log[at] if len(self.known) else 0)
        shares = np.where(new, self.kind_log[kinds], self.known_share[at] if len(self.known) else 0)
        tails: list[dict[bytes, int]] = [{} for _ in range(n)]
        for k, c in zip(doc[new[codes]].tolist(), codes[new[codes]].tolist()):
            tail, w = tails[k], names[c]
            tail[w] = tail.get(w, 0) + 1
        return stream, ends, np.bincount(doc, logs[codes], n), np.bincount(doc, shares[codes], n), tails


def shapes() -> dict[str, tuple[int, ...]]:
    return {
        "E": (CLASSES * PER_CLASS, EMBED), "Wx": (EMBED, 3 * HIDDEN), "Wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,),
        "Wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "Wo": (CLASSES, PER_CLASS, HIDDEN), "bo": (CLASSES, PER_CLASS),
    }


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The weights by name, as parts of one array."""
    out, at = {}, 0
    for k, shape in shapes().items():
        n = int(np.prod(shape))
        out[k], at = flat[at : at + n].reshape(shape), at + n
    return out


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def initial(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random recurrent weights; output biases that make the unigram distribution."""
    rng = np.random.default_rng(seed)
    c = (vocabulary.counts + 0.5).reshape(CLASSES, PER_CLASS)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype("f4")
    return {
        "E": draw(CLASSES * PER_CLASS, EMBED) * np.float32(8.0), "Wx": draw(EMBED, 3 * HIDDEN), "Wh": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, "f4"),
        "Wc": np.zeros((HIDDEN, CLASSES), "f4"), "bc": np.log(c.sum(1) / c.sum()).astype("f4"),
        "Wo": np.zeros((CLASSES, PER_CLASS, HIDDEN), "f4"), "bo": np.log(c / c.sum(1, keepdims=True)).astype("f4"),
    }


def recur(p: dict, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, HIDDEN, lanes) after each input of x (steps, lanes), h (HIDDEN, lanes) being those before; fresh marks the first input of a document.

    With units before lanes each gate is one block of memory. keep: gets embeddings, the states before, both gates, candidates, and what the
    states add to the candidates.
    """
    n, half = HIDDEN, p["E"].dtype.type(0.5)
    scale = np.repeat([half, half, p["E"].dtype.type(1)], n)[:, None]  # sigmoid(x) = (1 + tanh(x / 2)) / 2
    embedded, wh = p["E"].take(x, axis=0), p["Wh"].T * scale
    gx = np.matmul(p["Wx"].T * scale, embedded.transpose(0, 2, 1))
    gx += p["b"][:, None] * scale
    gates, cand = gx[:, : 2 * n], gx[:, 2 * n :]
    out = np.empty((len(x), n, x.shape[1]), gx.dtype)
    before, added = (np.empty_like(out), np.empty_like(out)) if keep is not None else (None, None)
    starts, carry = fresh.any(axis=1).tolist(), (~fresh).astype(gx.dtype)
    gh, some = np.empty((3 * n, x.shape[1]), gx.dtype), np.empty_like(h)
    for t in range(len(x)):
        if starts[t]:
            h = h * carry[t]
        np.matmul(wh, h, out=gh)
        zr, c = gates[t], cand[t]
        zr += gh[: 2 * n]
        np.tanh(zr, out=zr)
        zr *= half
        zr += half
        np.multiply(zr[n:], gh[2 * n :], out=some)
        c += some
        np.tanh(c, out=c)
        if before is not None:
            before[t], added[t] = h, gh[2 * n :]
        o = out[t]
        np.subtract(h, c, out=o)
        o *= zr[:n]
        o += c
        h = o
    if keep is not None:
        keep += [embedded, before, gates, cand, added]
    return out


def rows_of(states: np.ndarray) -> np.ndarray:
    """(steps * lanes, HIDDEN)"""
    return states.transpose(0, 2, 1).reshape(-1, HIDDEN)


def _class_logits(p: dict, states: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Logits within the target's class and the states, both in order of the class; the order; the ends of the classes."""
    cls = (y // PER_CLASS).astype("i2")
    order = np.argsort(cls, kind="stable")
    s, ends = states[order], np.cumsum(np.bincount(cls, minlength=CLASSES)).tolist()
    logits = np.empty((len(y), PER_CLASS), s.dtype)
    a = 0
    for k, b in enumerate(ends):
        if b > a:
            part = logits[a:b]
            np.matmul(s[a:b], p["Wo"][k].T, out=part)
            part += p["bo"][k]
        a = b
    return logits, s, order, ends


def _shares(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the logits less a constant of their row, in place, and its sums. The constant is the largest of all logits, or of the row's where that is far away."""
    if not len(logits):
        return logits, np.zeros(0, logits.dtype)
    top, one = logits.max(), np.ones(logits.shape[1], logits.dtype)
    far = np.nonzero(logits[:, 0] < top - 60)[0]
    far = far[logits[far].max(axis=1) < top - 60]
    logits -= top
    logits[far] -= logits[far].max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ one


def log_output(p: dict, states: np.ndarray, y: np.ndarray, together: int = 4096) -> np.ndarray:
    """log P of the targets y given states (n, HIDDEN)."""
    out = np.empty(len(y))
    for lo in range(0, len(y), together):
        s, t = states[lo : lo + together], y[lo : lo + together]
        rows = np.arange(len(t))
        inside, _, order, _ = _class_logits(p, s, t)
        ei, si = _shares(inside)
        ec, sc = _shares(s @ p["Wc"] + p["bc"])
        part = np.empty(len(t))
        part[order] = np.log(np.maximum(ei[rows, (t % PER_CLASS)[order]], 1e-37)) - np.log(si)
        out[lo : lo + together] = part + np.log(np.maximum(ec[rows, t // PER_CLASS], 1e-37)) - np.log(sc)
    return out


def output_gradients(p: dict, states: np.ndarray, y: np.ndarray, g: dict) -> tuple[np.ndarray, float]:
    """The gradient of the loss (negative log-likelihood) by the states, those of the output weights into g (zeros so far), and the loss."""
    pw, s, order, ends = _class_logits(p, states, y)
    y = y[order]
    rows, cls, pos = np.arange(len(y)), y // PER_CLASS, y % PER_CLASS
    pw, sums = _shares(pw)
    pw *= (1 / sums)[:, None]
    pc, sums = _shares(s @ p["Wc"] + p["bc"])
    pc *= (1 / sums)[:, None]
    loss = -float(np.log(np.maximum(pc[rows, cls], 1e-30)).sum() + np.log(np.maximum(pw[rows, pos], 1e-30)).sum())
    pc[rows, cls] -= 1
    pw[rows, pos] -= 1
    one = np.ones(len(y), s.dtype)
    np.matmul(s.T, pc, out=g["Wc"])
    np.matmul(one, pc, out=g["bc"])
    ds, a = np.empty_like(s), 0
    for k, b in enumerate(ends):
        if b > a:
            q = pw[a:b]
            np.matmul(q.T, s[a:b], out=g["Wo"][k])
            np.matmul(one[a:b], q, out=g["bo"][k])
            np.matmul(q, p["Wo"][k], out=ds[a:b])
        a = b
    ds += pc @ p["Wc"].T
    back = np.empty_like(ds)
    back[order] = ds
    return back, loss


def gradients(p: dict, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, mask: np.ndarray, h: np.ndarray, g: dict | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of the summed loss over one window, the last states, and the loss. h: states (HIDDEN, lanes) before; g: zeros that take the gradients."""
    n, kept = HIDDEN, []
    g = {k: np.zeros_like(w) for k, w in p.items()} if g is None else g
    states = recur(p, x, fresh, h, kept)
    embedded, before, gates, cand, added = kept
    rows, targets = rows_of(states), np.ascontiguousarray(y).ravel()
    if mask.all():
        by_state, loss = output_gradients(p, rows, targets, g)
    else:
        live = np.nonzero(mask.ravel())[0]
        by_state = np.zeros_like(rows)
        by_state[live], loss = output_gradients(p, rows[live], targets[live], g)
    by_state = by_state.reshape(*x.shape, n).transpose(0, 2, 1)
    back = np.empty((len(x), 4 * n, x.shape[1]), rows.dtype)  # by candidate, update, reset, and what the states add to the candidate
    dh, some, through = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
    starts, carry = fresh.any(axis=1).tolist(), (~fresh).astype(rows.dtype)
    dwh, part = np.zeros((n, 3 * n), rows.dtype), np.empty((n, 3 * n), rows.dtype)
    for t in range(len(x) - 1, -1, -1):
        b, z, r, c, was = back[t], gates[t, :n], gates[t, n:], cand[t], before[t]
        dc, dz, dr, da = b[:n], b[n : 2 * n], b[2 * n : 3 * n], b[3 * n :]
        dh += by_state[t]
        np.subtract(1, z, out=some)
        np.multiply(dh, some, out=dc)
        some *= z
        np.subtract(was, c, out=dz)
        dz *= some
        dz *= dh
        np.multiply(c, c, out=some)
        np.subtract(1, some, out=some)
        dc *= some
        np.multiply(dc, r, out=da)
        np.subtract(1, r, out=some)
        np.multiply(da, some, out=dr)
        dr *= added[t]
        np.matmul(p["Wh"], b[n:], out=through)
        dh *= z
        dh += through
        if starts[t]:
            dh *= carry[t]
        dwh += np.matmul(was, b[n:].T, out=part)
    g["Wh"][...] = dwh
    dgx = back[:, : 3 * n]
    turned = np.concatenate([p["Wx"][:, 2 * n :], p["Wx"][:, : 2 * n]], axis=1)
    back_to = lambda w: np.concatenate([w[..., n:], w[..., :n]], axis=-1)
    g["b"][...] = back_to(np.matmul(dgx, np.ones(x.shape[1], rows.dtype)).sum(0))
    g["Wx"][...] = back_to(np.matmul(dgx, embedded).sum(0).T)
    cell = (x[..., None] * EMBED + np.arange(EMBED)).ravel()
    g["E"] += np.bincount(cell, np.matmul(dgx.transpose(0, 2, 1), turned.T).ravel(), g["E"].size).reshape(g["E"].shape)
    return g, states[-1], loss


def windows(docs: Iterable[tuple[int, np.ndarray]], n: int, steps: int, end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows (steps, lanes) of up to n lanes: inputs, targets, fresh, whether there is a target, its document's number; and the lanes that go on from the window before.

    A lane takes the next document where one ends, within a window too; when no document is left, lanes that end drop out.
    """
    docs, running = iter(docs), np.arange(0)
    lanes: list[tuple[int, np.ndarray, int]] = []
    more = True
    while True:
        while more and len(lanes) < n:
            d = next(docs, None)
            if d is None:
                more = False
            else:
                lanes.append((*d, 0))
        if not lanes:
            return
        x, y = np.full((len(lanes), steps), end, "i4"), np.zeros((len(lanes), steps), "i4")
        fresh, number = np.zeros(x.shape, bool), np.full(x.shape, -1, "i8")
        left, going = [], []
        for k, (name, ids, at) in enumerate(lanes):
            t = 0
            while t < steps:
                m = min(steps - t, len(ids) - at)
                y[k, t : t + m] = ids[at : at + m]
                number[k, t : t + m] = name
                if at:
                    x[k, t : t + m] = ids[at - 1 : at + m - 1]
                else:
                    fresh[k, t] = True
                    x[k, t + 1 : t + m] = ids[: m - 1]
                t, at = t + m, at + m
                if at == len(ids):
                    d = next(docs, None) if more else None
                    if d is None:
                        more, ids = False, None
                        break
                    (name, ids), at = d, 0
            if ids is not None:
                left.append((name, ids, at))
                going.append(k)
        yield x.T, y.T, fresh.T, number.T >= 0, number.T, running
        lanes, running = left, np.array(going, int)


def _carried(h: np.ndarray, running: np.ndarray, lanes: int) -> np.ndarray:
    """The states of the lanes that go on, and zeros for those that are new."""
    out = np.zeros((HIDDEN, lanes), h.dtype)
    out[:, : len(running)] = h[:, running]
    return out


def _keep_memory() -> None:
    """Free one large array: the C library then keeps freed memory for the many arrays of some megabytes instead of giving it back each time."""
    np.empty(30 << 20, "u1")


def train(p: dict, docs: Iterator[np.ndarray], end: int, rate: float = RATE) -> tuple[dict, int]:
    """One pass by Adam over the documents, each window an update (in proportion to its tokens where documents run out); returns new weights and the tokens read."""
    _keep_memory()
    flat = flatten(p)
    p = views(flat)
    grad, m, v, some = (np.zeros_like(flat) for _ in range(4))
    g, h = views(grad), np.zeros((HIDDEN, 0), flat.dtype)
    step = tokens = 0
    for x, y, fresh, mask, _, running in windows(((0, d) for d in docs), LANES, STEPS, end):
        grad[...] = 0
        _, h, _ = gradients(p, x, y, fresh, mask, _carried(h, running, x.shape[1]), g)
        n = int(mask.sum())
        tokens, step = tokens + n, step + 1
        lr = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step) * min(1, n / (LANES * STEPS)))
        grad *= np.float32(1 / n)
        m *= np.float32(0.9)
        np.multiply(grad, np.float32(0.1), out=some)
        m += some
        v *= np.float32(0.99)
        np.multiply(grad, grad, out=some)
        some *= np.float32(0.01)
        v += some
        np.sqrt(v, out=some)
        some += np.float32(1e-6)
        np.divide(m, some, out=some)
        some *= lr
        flat -= some
    return {k: w.copy() for k, w in p.items()}, tokens


def log_likelihoods(p: dict, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log-likelihood of each document, the state carried through all its windows; the longest start first."""
    _keep_memory()
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    out, h = np.zeros(len(docs)), np.zeros((HIDDEN, 0), p["E"].dtype)
    for x, y, fresh, mask, number, running in windows(((i, docs[i]) for i in order), SCORE_LANES, SCORE_STEPS, end):
        states = recur(p, x, fresh, _carried(h, running, x.shape[1]))
        h = states[-1]
        live = np.nonzero(mask.ravel())[0]
        out += np.bincount(number.ravel()[live], log_output(p, rows_of(states)[live], y.ravel()[live]), len(docs))
    return out


def fit(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, text_col: str = "text") -> dict:
    """Weights after `rounds` rounds, each over its own share (by text hash) of the documents, averaged over the tasks by tokens."""
    spark, p = docs.sparkSession, initial(vocabulary)
    vocab = spark.sparkContext.broadcast(vocabulary)
    row = "part int, lot int, tokens long, weights binary"

    def piece(part: list, lot: list, tokens: list, weights: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lot, pa.int32()), pa.array(tokens, pa.int64()), pa.array(weights, pa.binary())], names=["part", "lot", "tokens", "weights"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(0), 0
        for table in batches:
            for w, n in zip(table.column("weights").to_pylist(), table.column("tokens").to_pylist()):
                total, tokens = np.frombuffer(w) + (total if len(total) else 0), tokens + n
        yield piece([key[0].as_py()], [0], [tokens], [total.tobytes()])

    for r in range(rounds):
        start = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            new, tokens = train(start.value, (d for b in batches for d in vocab.value.ids_of(_texts(b, text_col))), vocab.value.end)
            if tokens:
                flat, lot = flatten(new).astype("f8") * tokens, TaskContext.get().partitionId() // TASKS_TOGETHER
                parts = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
                yield piece(list(range(len(parts))), [lot] * len(parts), [tokens] * len(parts), parts)

        own = docs.where(F.pmod(F.xxhash64(text_col), F.lit(rounds)) == r).select(text_col)
        sums = map_batches(own, run, row).groupBy("part", "lot").applyInArrow(add, row).groupBy("part").applyInArrow(add, row)
        found = sorted(sums.collect(), key=lambda x: x["part"])
        if found:
            p = views(np.concatenate([np.frombuffer(x["weights"]) / x["tokens"] for x in found]).astype("f4"))
    return p


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most `most` of them, as far as whole steps of frequency (a sixteenth of a doubling) go.

    How many words each step holds is a table of some hundred rows, so no task sends the driver words that it would then drop.
    """
    step = F.floor(F.log2("c") * 16)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    rows = [] if least is None else counts.where(step >= least).select("word", "c").collect()
    return sorted(((r["word"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def learn_vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    kinds = counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    return Vocabulary(most_frequent(counts, KNOWN), {r["kind"]: (r["n"], r["v"]) for r in kinds}, documents, sum(r["n"] for r in kinds), sum(r["v"] for r in kinds))


def score_documents(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, learnt, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model), both log10."""
    docs = docs.select(F.col(id_col), F.col(text_col).alias("text"), (F.lit(True) if learn_from is None else F.coalesce(learn_from, F.lit(False))).alias("learnt"))
    training = docs.where("learnt")
    counts = materialise(count_words(training), "lm-counts")
    vocabulary = learn_vocabulary(counts, training.count())
    weights = fit(training, vocabulary, rounds)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps((vocabulary, weights)))
    unit = float(np.log10(vocabulary.tokens + vocabulary.types + 1))
    end_log = float(np.log10(vocabulary.documents + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = pickle.loads(sent.value)
        tail_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for lo, hi, ids, ends, logs, shares, tails in v.read(_texts(batch, "text")):
                part = batch.slice(lo, hi - lo)
                tokens = np.diff(ends, prepend=0)
                model = log_likelihoods(p, np.split(ids, ends[:-1]), v.end) / np.log(10)
                unknown = np.array([sum(t.values()) for t in tails])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("uid"), part.column(id_col), part.column("learnt"), pa.array(tokens, pa.int64()), pa.array(tokens - 1 - unknown, pa.int64()),
                        pa.array(logs + end_log - tokens * unit, pa.float64()), pa.array(model + shares, pa.float64()),
                        pa.array([[{"word": w.decode(), "n": n} for w, n in t.items()] for t in tails], tail_type),
                    ],
                    names=["uid", id_col, "learnt", "n_tokens", "n_known", "base", "model", "tail"],
                )

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    schema = f"uid long, {id_col} {kind_of_id}, learnt boolean, n_tokens long, n_known long, base double, model double, tail array<struct<word:string,n:long>>"
    rows = materialise(map_batches(docs.withColumn("uid", F.monotonically_increasing_id()), run, schema), "lm-scores")
    rare = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.n").join(counts.select("word", "c"), "word", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("seen"))
    all_rows = rows.drop("tail").join(rare, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return all_rows.select(
        id_col, "learnt", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0)) + int(vocabulary.documents > 0)).cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
