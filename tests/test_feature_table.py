"""Features that are kept up equal features computed anew, after any upserts."""

import datetime as dt
import random

import pytest

from tickloom.functions import prices
from tickloom.operators.feature_table import FeatureTable
from tickloom.operators.returns import featured

BARS, KEYS = "ticker string, ts timestamp_ntz, close double, bench string", "ticker string, ts timestamp_ntz"
COLUMNS = ["ret", "ar", "fwd", "car", "vol", "z"]


def features():
    return {"fwd": prices.forward_return(3), "car": prices.cum_abnormal_return(3), "vol": prices.realized_vol(8, 3), "z": prices.car_zscore(3, 8)}


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def as_dict(df):
    return {(r["ticker"], r["ts"]): tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_upserts(spark, tmp_path, seed):
    """Restated, late and new bars of stocks and of benchmarks, in batches of few and of many."""
    draw = random.Random(seed)
    bench = {"A": "M", "B": "M", "C": "N", "D": None, "M": None, "N": None}
    store = {(t, day(n)): 50 + draw.random() for t in bench for n in range(0, 120) if draw.random() < 0.8}
    table = FeatureTable(spark, str(tmp_path / "f"), features(), 3, 8, rows=16)
    batches = [store, *({(draw.choice(list(bench)), day(draw.randrange(140))): draw.choice([None, 0.0, 40 + draw.random()]) for _ in range(n)} for n in (1, 3, 30)), {("M", day(60)): 77.0}]
    for batch in batches:
        store.update(batch)
        bars = spark.createDataFrame([(t, at, c, bench[t]) for (t, at), c in store.items()], BARS)
        n = table.update(bars, spark.createDataFrame(list(batch), KEYS))
        got, want = as_dict(table.read()), as_dict(featured(bars, horizon=3, window=8, **features()))
        assert got.keys() == want.keys() == store.keys()
        for key in want:
            assert got[key] == pytest.approx(want[key], nan_ok=True), key
        assert n == len(store) if batch is store else n < len(store) or len(batch) > 3


def test_a_change_reaches_few(spark, tmp_path):
    bars = spark.createDataFrame([(t, day(n), 50.0 + n % 7, None) for t in ("A", "B") for n in range(1000)], BARS)
    table = FeatureTable(spark, str(tmp_path / "f"), features(), 3, 8, rows=20)
    assert table.update(bars, bars) == 2000
    assert table.update(bars, spark.createDataFrame([("A", day(500))], KEYS)) == 40  # its bucket, and the one before by the horizon
    assert table.update(bars, spark.createDataFrame([], KEYS)) == 0 and table.read().count() == 2000
