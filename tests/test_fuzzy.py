"""The edit-distance join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.text import nearest_name
from tickloom.operators import fuzzy
from tickloom.operators.fuzzy import near_pairs, nearest_names


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def drawn(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice("abä😀") for _ in range(draw.randrange(7))) for _ in range(n)]


@pytest.mark.parametrize(("edits", "pairs"), [(0, 100_000), (1, 100_000), (2, 100_000), (2, 10)])
def test_all_near_pairs(spark, edits, pairs):
    """Also where forms are so common that their pairs are made in parts."""
    a, b = drawn(1, 150) + [None, "kitten", "x" * 12], drawn(2, 150) + ["sitten", "mitten", "", None, "x" * 10]
    got = [tuple(r) for r in near_pairs(names(spark, a), names(spark, b), edits, pairs).collect()]
    every = names(spark, set(a) - {None}).crossJoin(names(spark, set(b) - {None}).toDF("other")).withColumn("edits", F.levenshtein("name", "other"))
    assert sorted(got) == sorted(tuple(r) for r in every.where(F.col("edits") <= edits).collect()) and len(got) == len(set(got))


def test_nearest_equals_the_list_in_the_plan(spark):
    known = ["Economical", "Standard", "PROMOS", "promo", "smal", "medium", "largest", "Smal"]
    values = ["economic", "STANDARD", "promox", "small", "mediun", "larges", "nothing like it", "", None, "promos"]
    left = names(spark, values).withColumn("row", F.monotonically_increasing_id())
    got = {r["row"]: (r["nearest"], r["edits"]) for r in nearest_names(left, names(spark, known + [None])).collect()}
    want = {r["row"]: r["w"] for r in left.select("row", nearest_name(F.col("name"), sorted(known)).alias("w")).collect()}
    assert {k: v[0] for k, v in got.items()} == want and len(got) == len(values)


def test_nothing(spark):
    assert nearest_names(names(spark, []), names(spark, ["a"])).count() == 0
    assert [tuple(r) for r in nearest_names(names(spark, ["a"]), names(spark, [])).collect()] == [("a", None, None)]


def test_no_table_of_forms_is_broadcast(spark):
    """Tables of a few MB of names have GB of forms; neither goes through the driver."""
    found = near_pairs(names(spark, drawn(1, 150)), names(spark, drawn(2, 150)), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1
    nearest = nearest_names(names(spark, drawn(1, 50)), names(spark, drawn(2, 50)))
    assert "Broadcast" not in nearest._jdf.queryExecution().executedPlan().toString()


def test_forms_are_made_in_many_tasks(spark):
    reached = fuzzy._reached(names(spark, ["abc", "abcdefgh", "ab"] + drawn(3, 60)), names(spark, ["abcde"]), 2)
    assert reached.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {len(r["name"]) for r in reached.collect()} <= set(range(3, 8))
