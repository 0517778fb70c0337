"""Quantiles by counts are bit-equal to those of a sort."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import selection

Q = {"low": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.37, "top": 1.0}


def want(values, fraction):
    v = sorted(values)
    place = fraction * (len(v) - 1)
    a, b = math.floor(place), math.ceil(place)
    return v[a] if a == b else (b - place) * v[a] + (place - a) * v[b]


DRAWS = {
    "normal": lambda d: d.gauss(0, 1),
    "ties": lambda d: float(d.randrange(3)),
    "one": lambda d: 7.5,
    "wide": lambda d: d.choice([-1, 1]) * 10.0 ** d.randrange(-300, 300),
    "close": lambda d: 1.0 + d.randrange(1000) * 2.0**-52,
    "huge": lambda d: d.choice([-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, -0.0, math.inf, -math.inf]),
    "few": lambda d: d.random(),
}


@pytest.mark.parametrize("n", [600, 601])
def test_bit_equal_by_group(spark, n):
    draw = random.Random(n)
    made = {k: [f(draw) for _ in range(5 if k == "few" else n)] for k, f in DRAWS.items()}
    made[None] = [draw.random() for _ in range(n)]
    rows = [(k, v) for k, vs in made.items() for v in vs] + [("normal", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: r for r in selection.quantiles(df, "v", Q, ["k"], small=20).collect()}
    assert got.keys() == made.keys() | {"nothing"}
    for k, values in made.items():
        for name, fraction in Q.items():
            exact = want(values, fraction)
            assert got[k][name] == exact or (math.isnan(exact) and math.isnan(got[k][name])), (k, name)
    assert got["nothing"]["mid"] is None


def test_over_all_and_equal_to_one_aggregate(spark):
    df = spark.range(5001).select((F.xxhash64("id") % 700 / 7).alias("v"))
    values = [r["v"] for r in df.collect()]
    for small in (10, 10**6):
        r = selection.quantiles(df, "v", Q, small=small).first()
        assert [r[name] for name in Q] == pytest.approx([np.quantile(values, f) for f in Q.values()])
    assert selection.quantiles(df, "v", Q, small=10).count() == 1


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert selection.quantiles(df, "v", {"mid": 0.5}, ["k"], small=1).count() == 0
    assert selection.quantiles(df, "v", {"mid": 0.5}, small=1).first()["mid"] is None
