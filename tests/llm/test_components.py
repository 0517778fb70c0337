import random

import numpy as np
import pytest
from helpers import groups
from pyspark.sql import functions as F

from tickloom.llm import components as c


@pytest.mark.parametrize("per_task", [500_000, 40])
def test_components(spark, monkeypatch, per_task):
    """With few edges a task the stars run as well."""
    monkeypatch.setattr(c, "EDGES_A_TASK", per_task)
    rng = random.Random(per_task)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(n, n + 1) for n in range(1000, 1100)] + [(5, 5)]
    want = {n: g for n, g in groups({n for e in edges for n in e}, edges).items()}
    got = {r["node"]: r["component"] for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: g for n, g in want.items() if n in got}
    assert set(want) - set(got) <= {n for n in want if list(want.values()).count(want[n]) == 1}


def test_no_edges(spark):
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    node, low = c.forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), low.tolist(), strict=True)) == {3: 1, 5: 1, 9: 8}


@pytest.mark.parametrize(("large", "most"), [(3, 50), (3, 1), (1000, 50)])
def test_facts_of_groups(spark, monkeypatch, large, most):
    monkeypatch.setattr(c, "LARGE", large)
    monkeypatch.setattr(c, "BROADCAST_GROUPS", most)
    rows = spark.range(100).selectExpr("id", "least(id % 13, 5) AS g")
    facts = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("g <> 4")
    got = c.with_group_facts(rows, facts, "g", "n").select("id", "g", "n", "top")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts, "g").select("id", "g", "n", "top").collect()))
