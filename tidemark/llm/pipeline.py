"""Corpus preparation: toxic documents, near duplicates and benchmark leaks go, secrets are masked, and what stays is packed.

Each stage works on all rows that the one before kept, and its result is written as Parquet and read again.

Defined results: a null text is scored, compared and packed as an empty one and stays null until then; rows without id stay (of a group of copies, one with
an id goes first); repeated rows are copies of each other; very long texts are read whole; an empty table, or one whose labels hold one class only, loses nothing to the
classifier; other columns pass every stage but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, packing, secret_trigrams, simhash_pivots, toxicity
from tidemark.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by a model that learns from the labels of the documents at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = next(n for k in range(len(docs.columns) + 1) if (n := f"toxicity{k}") not in {c.lower() for c in docs.columns})
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a shingle similarity of 0.8."""
    return simhash_pivots.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    masked = secret_trigrams.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack_windows),
]

#: No SQL: the classifier, the fingerprints and the tokenizer are beyond it. tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
