import duckdb
import pytest
from helpers import SF, awkward, documents, nothing, words
from pyspark.sql import functions as F

from tickloom.llm import mixing


def test_equals_sql(spark):
    got = mixing.mix(documents(spark)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(mixing.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    exact = ["doc_id", "source", "size", "source_size", "copies", "taken"]
    assert got[exact].values.tolist() == want[exact].values.tolist()
    assert got["target"].tolist() == pytest.approx(want["target"].tolist())


def test_law_of_the_mix(spark):
    docs = documents(spark)
    out = mixing.mix(docs)
    by = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("source_size"), F.max("size").alias("largest")).collect()
    assert sum(r["target"] for r in by) == pytest.approx(sum(r["source_size"] for r in by))
    assert all(r["target"] <= 3 * r["source_size"] + 1e-6 and abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1 for r in by)
    assert out.where("taken > 3 * size").count() == 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_excess_is_shared_again(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 10), ("c", 90)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["b"] == 30.0 and got["c"] == 270.0 and got["a"] == pytest.approx(700.0)


def test_awkward_documents(spark):
    docs = awkward(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == 14 and sorted(r["size"] for r in out) == sorted(len(words(r["text"])) for r in docs.collect())
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in out)


def test_empty_table_and_no_words(spark):
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.take(nothing(spark)).count() == 0
    blank = nothing(spark).union(spark.createDataFrame([(1, "", "en", "a", 0), (2, None, None, None, 0)], nothing(spark).schema))
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()] == [(0, 0, 0.0)] * 2
