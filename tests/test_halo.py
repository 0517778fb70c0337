"""Windows over buckets with halos equal windows over whole tickers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import prices
from tickloom.operators import halo
from tickloom.operators.returns import compute, featured

COLUMNS = ["ret", "ar", "fwd", "car", "vol", "z"]


def bars(spark, sizes, seed=1):
    """Bars with gaps of days and of years, zeros and nulls, and benchmarks that lack some of them."""
    draw, rows = random.Random(seed), []
    for ticker, n in sizes.items():
        day = dt.datetime(2000, 1, 1)
        for _ in range(n):
            day += dt.timedelta(days=draw.choice([1, 1, 1, 2, 700]), hours=draw.randrange(3))
            rows.append((ticker, day, draw.choice([None, 0.0]) if draw.random() < 0.03 else 50 + draw.random(), None if ticker == "M" else "M"))
            if ticker != "M" and draw.random() < 0.9:
                rows.append(("M", day, 100 + draw.random(), None))
    return spark.createDataFrame(list({r[:2]: r for r in rows}.values()), "ticker string, ts timestamp_ntz, close double, bench string")


def made(df, **how):
    out = featured(df, horizon=3, window=12, fwd=prices.forward_return(3), car=prices.cum_abnormal_return(3), vol=prices.realized_vol(12, 3), z=prices.car_zscore(3, 12), **how)
    return {(r["ticker"], r["ts"]): tuple(r[c] for c in COLUMNS) for r in out.collect()}


@pytest.mark.parametrize("rows", [1, 5, 12, 40])
def test_equal_to_whole_tickers(spark, rows):
    df = bars(spark, {"A": 130, "B": 30, "C": 2, "D": 41})
    want = made(df)
    got = made(df, rows=rows)
    assert got.keys() == want.keys() and len(want) == df.count()
    for key in want:
        assert got[key] == pytest.approx(want[key], nan_ok=True), key


def test_buckets_and_halos(spark):
    """No bucket holds more than its bars and halos, each bar is owned once, and rare tickers stay as they are."""
    df = bars(spark, {"A": 100, "B": 10})
    out = halo.spread(df.where("ticker <> 'M'"), 7, 2, 20)
    sizes = {r["ticker"]: (r["n"], r["own"]) for r in out.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.col("__own").cast("int")).alias("own")).collect()}
    assert sizes["B"] == (10, 10) and sizes["A\x000"] == (22, 20) and sizes["A\x001"] == (29, 20) and sizes["A\x004"] == (27, 20)
    assert halo.owned(out).columns == df.columns and halo.owned(out).exceptAll(df).count() == 0 and halo.owned(out).count() == 110
    assert halo.spread(df, 7, 2) is df and halo.owned(df) is df


def test_registry_takes_buckets(spark):
    df = bars(spark, {"A": 60})
    events = df.where("ticker = 'A'").select("ticker", F.col("ts").alias("as_of"))
    value = {r["as_of"]: r["value"] for r in compute("realized_vol", df, events, {"window": 9, "min_obs": 3}).collect()}
    out = featured(df, horizon=0, window=9, rows=7, value=prices.realized_vol(9, 3)).where("ticker = 'A'")
    assert {r["ts"]: r["value"] for r in out.collect()} == pytest.approx(value)


def test_empty(spark):
    df = bars(spark, {"A": 1}).limit(0)
    assert featured(df, fwd=prices.forward_return()).count() == 0
