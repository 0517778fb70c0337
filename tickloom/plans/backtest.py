"""From a trigger or events to evidence: the plan that puts the operators together."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.prices import FEATURES, cum_abnormal_return, forward_return
from tickloom.operators.asof import asof_join
from tickloom.operators.evidence import equity_curve, stats_record
from tickloom.operators.events import events_from_tags, triggered
from tickloom.operators.returns import compute, featured
from tickloom.shared import cut


@dataclass(frozen=True)
class Backtest:
    """The results of a backtest, the curve as a table, and the versions of the features in it."""

    rows: DataFrame
    stats: DataFrame
    curve: DataFrame
    feature_versions: dict[str, str]


UNKNOWN, AHEAD = "unknown score feature '{}'", "LOOK-AHEAD GUARD: score feature '{}' sees the outcome and can't predict it"


def guard(score_feature: str | None) -> None:
    """Refuses a predictor that is unknown or that looks ahead, before any plan is built."""
    if not score_feature:
        return
    if score_feature not in FEATURES:
        raise ValueError(UNKNOWN.format(score_feature))
    if FEATURES[score_feature].forward_looking:
        raise ValueError(AHEAD.format(score_feature))


def guard_problem(score_feature: Column) -> Column:
    """What guard() would say to the predictor that a row names; null where it may be used, or none is named."""
    said = lambda message: F.concat(*[x for k, part in enumerate(message.split("{}")) for x in ([score_feature] if k else []) + [F.lit(part)]])
    ahead = [name for name, f in FEATURES.items() if f.forward_looking]
    return F.when(F.coalesce(score_feature == "", F.lit(True)), None).when(~score_feature.isin(*FEATURES), said(UNKNOWN)).when(score_feature.isin(*ahead), said(AHEAD))


def evaluate(bars: DataFrame, events: DataFrame, horizon: int = 5, beta: float = 1.0, use_benchmark: bool = True, bucket_days: int | None = 366) -> DataFrame:
    """``events`` (ticker, as_of) with fwd and ar at the last bar up to as_of; both features are computed once a bar."""
    frame = featured(bars, use_benchmark, beta, horizon, 1, fwd=forward_return(horizon), car=cum_abnormal_return(horizon))
    return asof_join(events, frame.select("ticker", "ts", "fwd", F.col("car").alias("ar")), ["ticker"], "as_of", "ts", ["fwd", "ar"], bucket_days)


def backtest(bars: DataFrame, events: DataFrame | None = None, trigger: Mapping | None = None, tags: DataFrame | None = None, vertices: DataFrame | None = None, direction: str = "long", horizon: int = 5, score_feature: str | None = None, score_params: Mapping | None = None, beta: float = 1.0, use_benchmark: bool = True, curve_rows: int | None = None) -> Backtest:
    """Rows and statistics of explicit ``events``, or of those that ``trigger`` picks from ``tags``.

    ``bars`` have ticker, ts, close and bench. ``beta`` reaches the abnormal return only, not the score. With ``curve_rows``
    the statistics hold the curve too, as an array of at most so many rows.
    """
    guard(score_feature)
    if events is None:
        if trigger is None:
            raise ValueError("a backtest needs events or a trigger")
        events = triggered(events_from_tags(tags), trigger.get("match") or {}, tags, vertices).withColumn("as_of", F.col("as_of").try_cast("timestamp_ntz"))
    rows = evaluate(bars, events, horizon, beta, use_benchmark)
    versions = {name: FEATURES[name].version for name in ("forward_return", "cum_abnormal_return")}
    if score_feature:
        rows = compute(score_feature, bars, rows, score_params, use_benchmark).withColumnRenamed("value", "score").drop("name", "version")
        versions[score_feature] = FEATURES[score_feature].version
    rows = cut(rows)
    return Backtest(rows, stats_record(rows, direction, curve_rows), equity_curve(rows, direction), versions)
