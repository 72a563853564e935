"""Quality verdicts of held-out documents, with few labels and with none."""

import pytest
from pyspark.sql import functions as F

from poplineage.llm import quality, queries

RATES = {"/root/testdata/sf0.001": (0.1, 0.25), "/root/testdata/sf0.01": (0.02, 0.1)}


def kept(docs, labels):
    return docs.sparkSession.createDataFrame(
        quality.quality_rules(docs, labels).select("doc_id", "llm_quality.base_failed", "llm_quality.kept", "llm_quality.score").collect(),
        "doc_id long, base_failed boolean, kept boolean, score double",
    )


@pytest.mark.parametrize("folder", list(RATES))
def test_held_out(spark, folder):
    docs, labels = queries.table(spark, folder, "documents").select("doc_id", "text"), queries.table(spark, folder, "labels")
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)  # a fifth: not shown to the rules
    rows = kept(docs, labels.join(held, "doc_id", "left_anti")).filter("not base_failed").join(held, "doc_id").collect()
    assert len(rows) >= 10 and sum(not r.kept for r in rows) <= max(1, RATES[folder][0] * len(rows))
    others = kept(docs, labels).filter("not base_failed").join(labels, "doc_id", "left_anti").collect()
    assert sum(not r.kept for r in others) <= RATES[folder][1] * len(others)
    bad = kept(docs, labels).filter("not base_failed").join(labels.filter("quality = 0").select("doc_id").distinct(), "doc_id").collect()
    assert sum(not r.kept for r in bad) >= len(bad) / 2


@pytest.mark.parametrize("labelled", ["false", "quality = 0", "doc_id = 1"])
def test_no_and_few_labels(spark, labelled):
    """Without good labels the base rules decide; a few reject no text that passes them."""
    folder = "/root/testdata/sf0.001"
    docs, labels = queries.table(spark, folder, "documents").select("doc_id", "text"), queries.table(spark, folder, "labels")
    rows = kept(docs, labels.filter(labelled)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and any(r.kept for r in rows)
    if labelled != "doc_id = 1":
        assert all(r.score == 0 for r in rows)


def test_own_counts(spark):
    """A trusted document is scored as if its label were not there."""
    texts = [(k, " ".join(f"w{(k * 7 + j) % 40}" for j in range(60))) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = lambda ids: spark.createDataFrame([(k, 1) for k in ids], "doc_id long, quality int")
    score = lambda ids: {r.doc_id: r.score for r in kept(docs, labels(ids)).collect()}[3]
    assert score(range(6)) == pytest.approx(score([0, 1, 2, 4, 5]))
