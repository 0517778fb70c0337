"""Golden values of the price features, on hand-made series."""

import math
import statistics

import pytest
from conftest import days
from pyspark.sql import functions as F

from tickloom.functions import prices, text
from tickloom.operators.asof import asof_join
from tickloom.operators.returns import compute, with_features, with_returns

BAR = "ticker string, ts timestamp_ntz, close double, bench string"


def series(spark, close, bench=None, at=None):
    at = at or days(max(len(close), len(bench or [])))
    rows = [("A", t, None if c is None else float(c), "B") for t, c in zip(at, close)] + [("B", t, float(c), None) for t, c in zip(at, bench or [])]
    return spark.createDataFrame(rows, BAR)


def values(bars, use_benchmark=True, **features):
    frame = with_features(with_returns(bars, use_benchmark=use_benchmark), **features)
    return frame.where("ticker = 'A'").orderBy("ts").toPandas()


def test_forward_return(spark):
    out = values(series(spark, [100.0, 101, 102, 103, 104, 110]), False, fwd=prices.forward_return(5))
    assert out["fwd"][0] == pytest.approx(0.10) and out["fwd"][1:].isna().all()


def test_forward_return_needs_the_whole_window_and_a_close_that_is_not_zero(spark):
    assert values(series(spark, [100.0, 101, 102]), False, fwd=prices.forward_return(5))["fwd"].isna().all()
    assert values(series(spark, [0.0, 101]), False, fwd=prices.forward_return(1))["fwd"].isna().all()


def test_asof_position(spark):
    at = days(6)
    bars = series(spark, [10.0, 11, 12, 13, 14, 15]).select("ticker", "ts", "close")
    import datetime as dt

    events = spark.createDataFrame([("A", at[4] + dt.timedelta(days=1)), ("A", at[0] - dt.timedelta(days=10)), ("A", None), ("Z", at[3])], "ticker string, as_of timestamp_ntz")
    got = {(r["ticker"], r["as_of"]): r["close"] for r in asof_join(events, bars, ["ticker"], "as_of", "ts", ["close"]).collect()}
    assert got == {("A", at[4] + dt.timedelta(days=1)): 14.0, ("A", at[0] - dt.timedelta(days=10)): None, ("A", None): None, ("Z", at[3]): None}


@pytest.mark.parametrize("bucket", [None, 1, 7, 366])
def test_asof_join_equals_a_scan(spark, bucket):
    import random

    rng = random.Random(3)
    at = days(300)
    bars = [(rng.choice("AB"), rng.choice(at), rng.random()) for _ in range(150)]
    bars = list({(t, d): (t, d, c) for t, d, c in bars}.values())
    events = [(rng.choice("ABC"), rng.choice(at)) for _ in range(200)]
    got = asof_join(spark.createDataFrame(events, "ticker string, as_of timestamp_ntz"), spark.createDataFrame(bars, "ticker string, ts timestamp_ntz, close double"), ["ticker"], "as_of", "ts", ["close"], bucket)
    want = [(t, a, max(((d, c) for u, d, c in bars if u == t and d <= a), default=(None, None))[1]) for t, a in events]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_abnormal_returns(spark):
    out = values(series(spark, [100.0, 110, 121], [100.0, 105, 105]))
    assert out["ar"][1:].tolist() == pytest.approx([0.05, 0.10])


def test_car(spark):
    out = values(series(spark, [100.0, 110, 121], [100.0, 105, 105]), car=prices.cum_abnormal_return(2))
    assert out["car"][0] == pytest.approx(0.15) and out["car"][1:].isna().all()


def test_car_zscore(spark):
    close = [100.0]
    for t in range(1, 31):
        close.append(close[-1] * (1 + 0.001 * ((t % 5) - 2)))
    close += [close[-1] * 1.05] * 5
    out = values(series(spark, close, [100.0] * len(close)), z=prices.car_zscore(1, 30))
    sd = statistics.stdev(close[t] / close[t - 1] - 1 for t in range(1, 31))
    assert out["z"][30] == pytest.approx(0.05 / sd)


def test_gaps_in_the_benchmark_are_null_and_no_benchmark_is_raw(spark):
    at = days(4)
    rows = [("A", t, c, "B") for t, c in zip(at, [100.0, 110.0, 121.0, 133.1])] + [("B", at[0], 100.0, None), ("B", at[2], 110.0, None)]
    bars = spark.createDataFrame(rows, BAR)
    ar = values(bars)["ar"].tolist()
    assert math.isnan(ar[1]) and ar[2] == pytest.approx(0.1 - 0.1) and math.isnan(ar[3])
    assert values(series(spark, [100.0, 110]))["ar"].isna().all()  # benchmark named but empty
    assert values(series(spark, [100.0, 110]), False)["ar"][1] == pytest.approx(0.1)


def test_null_and_zero_closes(spark):
    ret = values(series(spark, [100.0, None, 110, 0, 5]), False)["ret"].tolist()
    assert all(math.isnan(ret[k]) for k in (0, 1, 2, 4)) and ret[3] == -1.0


def test_labels(spark):
    df = spark.createDataFrame([(2.0,), (-2.0,), (0.5,), (None,)], "v double")
    labels = df.select(text.label_from_value(F.col("v"), {"high": 1.5, "by": "abs"})).collect()
    assert [r[0] for r in labels] == ["high", "high", "low", None]


def test_registry(spark):
    bars = series(spark, [100.0, 101, 102, 103, 104, 110])
    events = spark.createDataFrame([("A", days(1)[0])], "ticker string, as_of timestamp_ntz")
    row = compute("forward_return", bars, events, use_benchmark=False).first()
    assert (row["name"], row["version"]) == ("forward_return", "1.0") and row["value"] == pytest.approx(0.1)
    with pytest.raises(KeyError, match="does_not_exist"):
        compute("does_not_exist", bars, events)
