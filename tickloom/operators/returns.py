"""The frame that price features are computed on: bars with simple, benchmark and abnormal returns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.prices import feature, simple_return
from tickloom.operators.asof import asof_join
from tickloom.operators.halo import ROWS, owned, spread

DEFAULT_BENCHMARK = "^NSEI"


def benchmark_of(tickers: DataFrame, symbols: DataFrame, default: str = DEFAULT_BENCHMARK) -> DataFrame:
    """``tickers`` with the column ``bench``: the symbol map's benchmark, or ``default`` where it has none or an empty one."""
    known = symbols.select(F.col("ticker").alias("__t"), F.nullif(F.col("benchmark"), F.lit("")).alias("__b")).dropDuplicates(["__t"])
    return tickers.join(known, tickers["ticker"] == known["__t"], "left").withColumn("bench", F.coalesce("__b", F.lit(default))).drop("__t", "__b")


def with_returns(bars: DataFrame, benchmarks: DataFrame | None = None, use_benchmark: bool = True, beta: float = 1.0) -> DataFrame:
    """``bars`` (ticker, ts, close and, with a benchmark, bench) with ``ret`` and ``ar``.

    The benchmark's return is taken over its own bars and then joined on (bench, ts): a bar on which the benchmark has
    none has a null ``ar``, and so has every bar if there is no bar of the benchmark at all. ``use_benchmark=False``
    gives raw returns. ``benchmarks`` are the bars to take benchmarks from, by default ``bars``, of which the owned count
    where they come from spread().
    """
    out = bars.withColumn("ret", simple_return())
    if not use_benchmark:
        return out.withColumn("ar", F.col("ret"))
    # by default the same rows serve both sides, so what they are made of is shuffled once and read again
    market = owned(out if benchmarks is None else spread(benchmarks, 1, 0).withColumn("ret", simple_return()))
    market = market.select(F.col("ticker").alias("__bench"), F.col("ts").alias("__ts"), F.col("ret").alias("market")).where("market IS NOT NULL")
    joined = out.join(market, (out["bench"] == market["__bench"]) & (out["ts"] == market["__ts"]), "left")
    return joined.withColumn("ar", F.col("ret") - F.lit(beta) * F.col("market")).drop("__bench", "__ts", "market")


def with_features(frame: DataFrame, **features: Column) -> DataFrame:
    """``frame`` of with_returns() with named features, all over one sort of each ticker."""
    return frame.select("*", *[column.alias(name) for name, column in features.items()])


def featured(bars: DataFrame, use_benchmark: bool = True, beta: float = 1.0, horizon: int = 5, window: int = 60, rows: int = ROWS, **features: Column) -> DataFrame:
    """``bars`` with ret, ar and named features that reach ``window`` bars back and ``horizon`` ahead at most.

    Tickers of more than ``rows`` bars are cut into buckets with halos; the result is the same. Bars should be written.
    """
    frame = with_returns(spread(bars, max(window, 1), max(horizon, 0), rows), use_benchmark=use_benchmark, beta=beta)
    return owned(with_features(frame, **features))


def compute(name: str, bars: DataFrame, events: DataFrame, params: Mapping[str, object] | None = None, use_benchmark: bool = True) -> DataFrame:
    """``events`` (ticker, as_of) with name, version and value of a registered feature at the last bar up to as_of.

    Raises KeyError for an unknown name. The feature is computed once for every bar, then joined as of each event.
    """
    spec = feature(name)
    params = dict(params or {})
    beta = float(params.pop("beta", 1.0))
    window = max(int(params.get(k, 60)) for k in ("window", "vol_window"))
    frame = featured(bars, use_benchmark and spec.needs_bench, beta, int(params.get("horizon", 5)), window, value=spec.build(**params))
    values = frame.select("ticker", "ts", "value")
    joined = asof_join(events, values, ["ticker"], "as_of", "ts", ["value"])
    return joined.select(*events.columns, F.lit(name).alias("name"), F.lit(spec.version).alias("version"), "value")
