"""Event statistics against their definitions, and the guard against looking ahead."""

import math
import random
import statistics

import pytest

from tickloom.operators import evidence
from tickloom.operators.ranks import ordinal_ranks
from tickloom.plans.backtest import backtest, guard


EVENTS = "ticker string, as_of string, fwd double, score double"


def plain(fwd, sign=1):
    """The statistics of outcomes, from their definitions."""
    r = [sign * x for x in fwd if x is not None]
    n = len(r)
    sd = statistics.stdev(r) if n > 1 else 0
    return n, n and round(sum(x > 0 for x in r) / n, 4), n and statistics.fmean(r), n and statistics.median(r), round(statistics.fmean(r) / sd * math.sqrt(n), 3) if sd > 0 else None


def outcomes(seed, n):
    """Events of three tickers; some without outcome, some flat, some alike."""
    draw = random.Random(seed)
    return [(draw.choice("PQR"), f"20{draw.randrange(10, 20)}-03-{draw.randrange(1, 29):02d}", draw.choice([None, 0.0, 0.07, -0.2, draw.gauss(0.01, 0.1)]), draw.choice([None, draw.random()])) for _ in range(n)]


@pytest.mark.parametrize("small", [10**6, 10])
@pytest.mark.parametrize("direction", ["long", "short", "sideways"])
def test_statistics_by_ticker_and_over_all(spark, direction, small):
    made = outcomes(11, 400)
    df, sign = spark.createDataFrame(made, EVENTS), -1 if direction == "short" else 1
    names = ("n", "hit_rate", "avg_fwd", "median_fwd", "t_stat")
    got = {r["ticker"]: tuple(r[c] for c in names) for r in evidence.event_stats(df, direction, ["ticker"], small).collect()}
    got["*"] = tuple(evidence.event_stats(df, direction, small=small).first()[c] for c in names)
    for ticker in "PQR*":
        assert got[ticker] == pytest.approx(plain([f for t, _, f, _ in made if ticker in (t, "*")], sign), abs=1e-6)


def test_a_few_outcomes_by_hand(spark):
    """A win of 1/4, a loss of 1/5 and a flat one: money is back where it was, a third of them hit."""
    df = spark.createDataFrame([("P", "2011-05-03", 0.25, None), ("P", "2011-05-02", 0.0, None), ("Q", "2011-05-04", -0.2, None), ("Q", "2011-05-01", None, None)], EVENTS)
    r = evidence.stats_record(df, curve_rows=3).first()
    assert (r["n"], r["hit_rate"], r["avg_fwd"], r["median_fwd"], r["ic"]) == (3, 0.3333, 0.016667, 0.0, None)
    assert r["equity_curve"] == [1.0, 1.25, 1.0]
    assert [(x["as_of"], x["ticker"]) for x in evidence.skipped(df).collect()] == [("2011-05-01", "Q")]
    with pytest.raises(ValueError, match="3 rows"):
        evidence.stats_record(df, curve_rows=2)
    assert "equity_curve" not in evidence.stats_record(df).columns


def test_no_events_one_event_and_equal_ones(spark):
    none = spark.createDataFrame([], EVENTS)
    assert tuple(evidence.stats_record(none, curve_rows=0).first()) == (0, None, None, None, None, None, [])
    one = evidence.event_stats(spark.createDataFrame([("P", "2011-05-03", 0.3, 1.0)], EVENTS)).first()
    assert (one["n"], one["median_fwd"], one["t_stat"]) == (1, 0.3, None)
    alike = evidence.event_stats(spark.createDataFrame([("P", f"2011-05-0{k}", 0.3, 1.0) for k in range(1, 6)], EVENTS)).first()
    assert alike["t_stat"] is None and alike["hit_rate"] == 1.0


@pytest.mark.parametrize("seed", [1, 2])
def test_rank_correlation(spark, seed):
    """Pairs of score and outcome, ranked by value, then date and ticker."""
    made = list({r[:2]: r for r in outcomes(seed, 150)}.values())
    pairs = [r for r in made if r[2] is not None and r[3] is not None]
    place = lambda k: {r: n for n, r in enumerate(sorted(pairs, key=lambda r: (r[k], r[1], r[0])))}
    f, s = place(2), place(3)
    got = evidence.information_coefficient(spark.createDataFrame(made, EVENTS)).first()
    assert got["n_pairs"] == len(pairs) and got["ic"] == pytest.approx(statistics.correlation([f[r] for r in pairs], [s[r] for r in pairs]), abs=1e-4)
    assert evidence.information_coefficient(spark.createDataFrame(pairs[:2], EVENTS)).first()["ic"] is None


def test_ordinal_rank_over_ranges(spark):
    rng = random.Random(1)
    values = [(n, rng.choice([0.5, rng.random()])) for n in range(500)]
    got = ordinal_ranks(spark.createDataFrame(values, "k int, v double"), {"place": "v", "same": "k"}, ["k"], ranges=8).collect()
    assert {r["k"]: r["place"] for r in got} == {k: n for n, (k, _) in enumerate(sorted(values, key=lambda kv: (kv[1], kv[0])))}
    assert all(r["same"] == r["k"] for r in got)


def test_guard():
    guard(None)
    guard("realized_vol")
    with pytest.raises(ValueError, match="LOOK-AHEAD GUARD"):
        guard("car_zscore")
    with pytest.raises(ValueError, match="unknown score feature"):
        guard("nope")


def test_backtest_from_a_trigger(spark):
    from conftest import days

    at = days(30)
    bars = spark.createDataFrame([(t, d, 100.0 + n * (1 + (t == "A")), "B") for t in "AB" for n, d in enumerate(at)], "ticker string, ts timestamp_ntz, close double, bench string")
    day = f"{at[20]:%Y-%m-%d}"
    tags = spark.createDataFrame([(1, "ticker:A"), (1, f"asof:{day}"), (2, "ticker:B"), (2, f"asof:{day}")], "node_id long, tag string")
    nodes = spark.createDataFrame([(1, "Big Merger", None), (2, None, "nothing")], "id long, name string, text string")
    out = backtest(bars, trigger={"match": {"entityAny": ["merger"]}}, tags=tags, vertices=nodes, score_feature="realized_vol")
    row = out.rows.first()
    assert out.rows.count() == 1 and row["ticker"] == "A" and row["fwd"] == pytest.approx(150 / 140 - 1) and row["score"] > 0
    assert out.stats.first()["n"] == 1 and out.feature_versions == {"forward_return": "1.0", "cum_abnormal_return": "1.0", "realized_vol": "1.0"}
    with pytest.raises(ValueError, match="events or a trigger"):
        backtest(bars)


def test_one_value_and_one_group_are_many_ranges(spark):
    from pyspark.sql import functions as F

    from tickloom.operators.ranks import running

    rows = spark.range(1000).selectExpr("id", "1.0 AS v", "'one' AS day", "id % 7 AS used")
    got = running(rows, F.sum, F.col("used"), ["v", "id"], "so_far", ["day"], ranges=4)
    sums, total = {}, 0
    for i in range(1000):
        total += i % 7
        sums[i] = total
    assert {r["id"]: r["so_far"] for r in got.collect()} == sums
    ranges = rows.repartitionByRange(4, "day", "v", "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(ranges) == 4 and max(r["count"] for r in ranges) < 500
