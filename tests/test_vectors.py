"""Recall of many queries against single comparisons, row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators import vectors


def one_by_one(v, q, k):
    pairs = v.crossJoin(q).select("query_id", "vec_id", vectors.cosine(F.col("embedding"), F.col("query")).alias("score")).where("score IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def rows(df):
    return sorted((r["query_id"], str(r["vec_id"]), repr(r["score"])) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_equals_single_comparisons_to_the_last_bit(spark, monkeypatch, small):
    """Also copies, null, zero, short and not finite vectors, in one block or many."""
    if small:
        for name, n in (("QUERIES", 8), ("VECTORS", 32), ("AT_ONCE", 3), ("PAIRS", 20)):
            monkeypatch.setattr(vectors, name, n)
    drawn = np.random.default_rng(5).normal(size=(120, 7)).round(2).tolist()
    known = list(enumerate(drawn)) + [(500 + i, drawn[i % 3]) for i in range(40)]
    known += [(900, None), (901, [0.0] * 7), (902, [1.0] * 3), (903, [None] + [1.0] * 6), (904, []), (None, drawn[5]), (905, [1e200] * 7), (906, [1e-200] * 7)]
    v = spark.createDataFrame(known, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = rows(vectors.recall_each(v, q, 6))
    assert got == rows(one_by_one(v, q, 6)) and len(got) > 150
    odd = v.unionAll(spark.createDataFrame([(910, [float("nan")] * 7), (911, [float("inf")] + [1.0] * 6)], v.schema))
    assert rows(vectors.recall_each(odd, q.where("query_id < 30"), 3)) == rows(one_by_one(odd, q.where("query_id < 30"), 3))


def test_plan_and_tasks_dont_grow_into_single_comparisons(spark):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    plan = vectors.recall_each(v, v.toDF("query_id", "query"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert vectors.recall_each(v.limit(0), v.toDF("query_id", "query"), 2).count() == 0
    assert vectors.recall_each(v, v.limit(0).toDF("query_id", "query"), 2).count() == 0
