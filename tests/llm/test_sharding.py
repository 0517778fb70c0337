import zlib

import pytest
from helpers import awkward, documents, nothing
from pyspark.sql import functions as F

from tickloom.llm import sharding


def check(docs, out, shards=8):
    rows = out.collect()
    assert len(rows) == docs.count()
    want = sorted((((r["doc_id"]), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_bytes(spark, sf):
    docs = documents(spark, f"/root/testdata/{sf}")
    rows = check(docs, sharding.kd_shards(docs))
    sums = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 0.05 * max(sums) + max(r["size"] for r in rows)


def test_equal_texts_stay_together(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    out = sharding.kd_shards(docs)
    split = out.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n")).where("n > 1")
    assert split.where("shards > 1").count() <= 0.1 * split.count()


def test_native(spark):
    plan = sharding.kd_shards(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_awkward_documents(spark, shards):
    docs = awkward(spark)
    check(docs, sharding.kd_shards(docs, shards), shards)


def test_reruns_agree_and_empty(spark):
    docs = documents(spark)
    a, b = (sorted(map(tuple, sharding.kd_shards(d).select("doc_id", "shard").collect())) for d in (docs, docs.repartition(5)))
    assert a == b and sharding.kd_shards(nothing(spark)).count() == 0


def test_one_large_group_of_copies(spark):
    rows = [(n, "the very same text" if n % 3 else f"text {n} " * 3, "en", "a", 0) for n in range(600)]
    docs = spark.createDataFrame(rows, nothing(spark).schema)
    got = check(docs, sharding.kd_shards(docs))
    sums = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sums) - min(sums) <= 120
