from __future__ import annotations

import corpus_pipeline as cp
import pytest

from tests.compare import check
from tidemark.llm import catalog, decontamination, secret_trigrams
from tidemark.llm.common import materialise


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in cp.STAGES:
            before, now = now, materialise(stage(spark, now, sf), "test-stage")
            if name != "packing":
                assert now.columns == docs.columns and now.count() <= before.count()


def test_decisions_take_effect(spark, sf):
    now = spark.read.parquet(f"{sf}/documents.parquet")
    n = [now.count()]
    for name, stage in cp.STAGES[:4]:
        now = materialise(stage(spark, now, sf), "test-stage")
        n.append(now.count())
    assert n[0] > n[1] > n[2] > n[3] == n[4] and n[4] > 0.7 * n[0]
    assert decontamination.find_leaks(now, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert secret_trigrams.scan(now).where("size(__found) > 0").count() == 0
    assert now.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    check(catalog.QUERIES[name](spark, sf), duck.sql(catalog.ORACLES[name]))
