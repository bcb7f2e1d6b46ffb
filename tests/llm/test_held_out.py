"""Accuracy on documents that were not learned from, on the given tables."""

from pathlib import Path

import pytest

from reelspark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given tables are not there")


def _held(spark, name, truth, key):
    got = QUERIES[name](spark, FOLDER)
    table = spark.read.parquet(f"{FOLDER}/{truth}.parquet").select("doc_id", key)
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    return got.filter("held_out").join(table, "doc_id").collect()


@pytest.mark.parametrize("name, truth, key, guess, least", [
    ("op2_quality_classifier", "labels", "quality", "predicted", 0.95),
    ("op5_toxicity", "labels", "toxic", "predicted", 0.92),
    ("op8_language_id", "documents", "lang", "lang_pred", 0.97),
])
def test_accuracy(spark, name, truth, key, guess, least):
    rows = _held(spark, name, truth, key)
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r[guess] == r[key] for r in rows) / len(rows) >= least
    if name == "op5_toxicity":  # few are toxic, so that none is found must not pass
        toxic = [r for r in rows if r.toxic]
        assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
        assert sum(r.predicted for r in rows) <= 2 * len(toxic)
