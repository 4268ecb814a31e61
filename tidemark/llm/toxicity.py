"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed lexicon of insults and of one learnt from labelled rows, second-person words close to such
words, capitals, punctuation, and obfuscated spellings (figures or marks inside words, stretched letters), which are also undone and looked up.

Labels are learnt from at most `MAX_ROWS` labelled rows, chosen by hash of their id (the bound on the classifier's sample). The calibration
is fitted to the margins that each quarter of them, again by hash, gets from trees fitted to the other three. Every document is scored whole. Label, id, language and source are no inputs. A null text counts as
empty and is scored as one; rows without an id are scored too and are never learnt from. A document with several labels is toxic if one says so.
Without labels of both kinds all scores are the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import map_batches, materialise, own_names

MAX_ROWS = 20_000
#: Common insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb fool fools loser losers clown clowns scum trash garbage pathetic worthless disgusting disgust jerk ugly"
    " hate hated hateful kill die shut vermin filth filthy imbecile dumbass crap damn bastard freak pig pigs rat liar coward cretin"
    " imbécile idiote stupide connard salaud crétin dummkopf trottel arschloch blöd idioten estúpido estupido imbécil tonto basura asqueroso".split()
)
SECOND = frozenset("you your yours yourself youre you're u ur tu te toi vous votre vos du dich dir dein deine euch sie ihr usted ustedes tú ti".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”„«»¡¿–—"
ODD_WORD = re.compile(r"(?<![^\W_])[^\W\d_]+[0-9@$!|*._-]+[^\W\d_][^\s]*")
STRETCH = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = (
    "words chars fixed_density fixed_count learnt_density learnt_count learnt_weight learnt_top close_second second_density"
    " capitals shouted marks exclaims questions stars odd_density undone_density stretched mean_word distinct_share"
).split()
NEAR = 5
#: Words of the learnt lexicon, and labelled rows a word must stand in.
LEXICON, LEAST_ROWS = 500, 5
#: Standard deviations by which a word must stand in more toxic rows than its share, so that rare words do not enter by chance.
SIGNIFICANT = 4.0


def clean_words(text: str) -> list[str]:
    return [w for w in (x.strip(MARKS) for x in text.lower().split()) if w]


def features(text: str | None, lexicon: dict[str, float]) -> list[float]:
    text = text or ""
    words = clean_words(text)
    n, chars = max(1, len(words)), max(1, len(text))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    weights = [lexicon[w] for w in words if w in lexicon]
    odd = ODD_WORD.findall(text.lower())
    undone = 0
    for w in odd:
        plain = w.strip(MARKS).translate(LEET)
        plain = STRETCH.sub(r"\1", re.sub(r"[\W_]", "", plain))
        undone += plain in INSULTS or plain in lexicon
    hits = sorted({*fixed, *(i for i, w in enumerate(words) if w in lexicon)}) if weights or fixed else []
    close = 0
    seconds = [i for i, w in enumerate(words) if w in SECOND]
    for i in seconds if hits else ():
        k = bisect_left(hits, i - NEAR)
        close += k < len(hits) and hits[k] <= i + NEAR
    capitals = sum(map(str.isupper, text))
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    marks = sum(map(text.count, "!?*.,;:'\"-_()[]{}#$%&@/|"))
    return [
        len(words), chars, len(fixed) / n, len(fixed), len(weights) / n, len(weights), sum(weights) / n, max(weights, default=0.0), close / n, len(seconds) / n,
        capitals / chars, shouted / n, marks / chars, text.count("!") / n, text.count("?") / n, text.count("*") / n, len(odd) / n, undone / n,
        sum(1 for _ in STRETCH.finditer(text)) / n, sum(map(len, words)) / n, len(set(words)) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features. features, cuts: (trees, nodes); values: (trees, leaves)."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype("u1")

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.values.shape[1]))
        for f, c, v in zip(self.feature, self.cut, self.values):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (binned[rows, f[at]] > c[at])
            out += v[at - (2**depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 48, least: float = 20.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss with histograms; ties between splits go to the first feature and cut."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    model = Trees(edges, np.zeros((trees, 2**depth - 1), int), np.full((trees, 2**depth - 1), 255), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    binned, margin, width = model.bins(x).astype(int), np.full(len(y), model.base), bins + 1
    offset = binned + np.arange(x.shape[1]) * width
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        at = np.zeros(len(y), int)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            size = x.shape[1] * width
            index = ((at - first)[:, None] * size + offset).ravel()
            shape = (nodes, x.shape[1], width)
            gs, hs, ns = (np.bincount(index, np.repeat(v, x.shape[1]) if v is not None else None, nodes * size).reshape(shape).cumsum(axis=2) for v in (g, h, None))
            gt, ht, nt = gs[..., -1:], hs[..., -1:], ns[..., -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(ns < least) | (nt - ns < least)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            model.feature[t, first : first + nodes] = np.where(good, best // width, 0)
            model.cut[t, first : first + nodes] = np.where(good, best % width, 255)
            at = 2 * at + 1 + (binned[np.arange(len(y)), model.feature[t, at]] > model.cut[t, at])
        leaf = at - (2**depth - 1)
        gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        model.values[t] = -rate * gl / (hl + ridge)
        margin += model.values[t][leaf]
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and values of the calibration curve, each value drawn a little to the overall share."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of margins
    for m, v in zip(margin[order], y[order]):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a)]
    share = float(y.mean())
    s = np.array(blocks)
    return s[:, 2] / s[:, 1], np.maximum.accumulate((s[:, 0] + share) / (s[:, 1] + 1))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    places: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.values[0])
        return np.interp(self.trees.margin(x), self.places, self.values)


def labelled_sample(labels: DataFrame, learn_from, id_col: str, label_col: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """(id, toxic, part): at most about max_rows labelled ids in four parts."""
    rows = labels.where(learn_from & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("toxic"))
    n, steps = rows.count(), 1 << 20
    mark = F.pmod(F.xxhash64(F.lit("toxicity"), id_col), F.lit(steps))
    return rows.where(mark < F.lit(int(steps * min(1.0, max_rows / max(1, n))))).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), id_col), F.lit(4)))


def learn_lexicon(texts: DataFrame, text_col: str, size: int = LEXICON, least_rows: int = LEAST_ROWS) -> dict[str, float]:
    """Words (of rows with `toxic`) by the log-odds of standing in a toxic row; the strongest `size`."""
    word = F.explode(F.array_distinct(F.transform(F.split(F.lower(text_col), r"\s+"), lambda w: F.regexp_replace(w, r"^[\p{Punct}…“”„«»¡¿–—]+|[\p{Punct}…“”„«»¡¿–—]+$", ""))))
    counts = texts.select("toxic", word.alias("word")).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    bad, n = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0.0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 0.5) / F.lit(bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / F.lit(n - bad + 1.0))
    expected = F.col("n") * F.lit(bad / max(1, n))
    strength = (F.col("bad") - expected) / F.sqrt(expected * F.lit(1 - bad / max(1, n)) + 1e-9)
    top = counts.where(F.col("n") >= least_rows).withColumns({"odds": odds, "strength": strength}).where(F.col("strength") >= SIGNIFICANT)
    top = top.orderBy(F.col("strength").desc(), "word").limit(size)
    return {r["word"]: float(r["odds"]) for r in top.collect()}


@own_names
def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with `x`: the features of each whole text."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("x", T.ArrayType(T.FloatType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t, lexicon) for t in batch.column("__text").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), x], names=schema.names)

    return map_batches(docs.select(*keep, F.col(text_col).alias("__text")), run, schema)


def _fit(rows: list[tuple], lexicon: dict[str, float]) -> Model:
    rows = sorted(rows)
    y = np.array([r[0] for r in rows])
    share = float(y.mean()) if len(y) else 0.0
    part = np.array([r[1] for r in rows])
    if not len(y) or not all(0 < y[part != k].sum() < (part != k).sum() for k in range(4)):
        return Model(lexicon, None, np.zeros(1), np.array([share]))
    x = np.array([r[2] for r in rows], "f4")
    least = min(20.0, max(2.0, len(y) / 200))
    margin = np.zeros(len(y))
    for k in range(4):
        out = part == k
        margin[out] = fit_trees(x[~out], y[~out], least=least).margin(x[out])
    return Model(lexicon, fit_trees(x, y, least=least), *isotonic(margin, y))


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model from the labels for which the column `learn_from` holds."""
    sample = materialise(labelled_sample(labels, F.lit(True) if learn_from is None else learn_from, id_col, label_col, max_rows), "toxic-labels")
    known = F.broadcast(sample) if max_rows <= MAX_ROWS else sample  # three numbers a row: under a megabyte
    texts = materialise(docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).join(known, id_col), "toxic-texts")
    lexicon = learn_lexicon(texts, text_col)
    rows = with_features(texts, lexicon, ["toxic", "part"], text_col).collect()
    return _fit([tuple(r) for r in rows], lexicon)


@own_names
def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns (all by default) with `score_col`: the calibrated probability that a row is toxic."""
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            x = np.array([features(t, m.lexicon) for t in batch.column("__text").to_pylist()], "f4").reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(m.score(x), pa.float64())], names=schema.names)

    return map_batches(docs.select(*keep, F.col(text_col).alias("__text")), run, schema)
