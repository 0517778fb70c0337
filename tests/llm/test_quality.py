import zlib

import numpy as np
import pytest
from helpers import awkward, documents, nothing
from pyspark.sql import functions as F

from tickloom.llm import quality

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.classify(documents(spark, sf), labels)
    return out.join(labels.select("doc_id", "quality").dropDuplicates(["doc_id"]), "doc_id").toPandas(), out


def test_held_out_accuracy(scored):
    rows = scored[0][scored[0]["held_out"]]
    auc = np.mean([a > b for a in rows.loc[rows.quality == 1, "score"] for b in rows.loc[rows.quality == 0, "score"]])
    right = (rows["predicted"] == rows["quality"]).mean()
    assert len(rows) > 500 and auc > 0.9 and right > 0.85, (auc, right)


def test_folds_and_ranges(scored):
    rows = scored[0]
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows["doc_id"]]).all()
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.7)).all()
    assert scored[1].count() == 10_000


def test_held_out_labels_are_not_learned(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    flipped = labels.withColumn("quality", F.when(fold == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    positive, unlabelled = rng.normal(1, 1, (300, len(quality.FEATURES))), rng.normal(0, 1, (600, len(quality.FEATURES)))
    unlabelled[:200] += 1
    model = quality.fit(positive, unlabelled, 1 / 3)
    s, t = model.score(rng.normal(1, 1, (200, len(quality.FEATURES)))), model.score(rng.normal(0, 1, (200, len(quality.FEATURES))))
    assert s.mean() > 0.7 > 0.3 > t.mean()


def test_awkward_documents(spark):
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, 0), (10, 0, 0), (7, None, None), (None, 1, 0), (0, 1, 0), (99, 0, 1)], LABELS)
    docs = awkward(spark)
    out = quality.classify(docs, labels).collect()
    assert len(out) == 14 and all(0 <= r["score"] <= 1 for r in out)
    blank = {r["score"] for r in out if r["doc_id"] in (1, 2)}
    assert len(blank) == 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 14


def test_without_documents_or_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.classify(nothing(spark), none).count() == 0
    assert {r["score"] for r in quality.classify(awkward(spark), none).collect()} == {0.5}


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """One id on many rows, with many labels: no more rows reach the driver than the bounds say."""
    monkeypatch.setattr(quality, "POSITIVES", 50)
    monkeypatch.setattr(quality, "UNLABELLED", 80)
    docs = spark.range(600).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some words and the number "), F.col("id").cast("string")).alias("text"))
    others = spark.range(100, 130).select(F.col("id").alias("doc_id"), F.lit("WORTHLESS | text").alias("text"))
    labels = spark.createDataFrame([(7, 1, 0)] * 300 + [(100, 0, 0)] * 5, LABELS)
    docs = docs.unionAll(others)
    positive, x = quality._sample(docs, labels.where("quality = 1").select("doc_id"), docs.select("doc_id"))
    assert positive.sum() == 50 and len(positive) - positive.sum() == 80 and x.shape == (130, len(quality.FEATURES))
    assert len(quality.classify(docs, labels).collect()) == 630
