"""Point-in-time and forward-looking price features as window expressions over the bar table.

Every builder gives a Column over a frame of ``ticker, ts, close, ret, ar`` in which ``ret`` is the simple return and
``ar`` the abnormal one; all share one window, so Spark sorts each ticker once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("ts")


def simple_return(close: str = "close") -> Column:
    """close over the close before, less 1; null at the start, after a zero and next to a null."""
    return F.try_divide(F.col(close), F.lag(close).over(by_ticker())) - 1


def forward_return(horizon: int = 5) -> Column:
    """The return over the next ``horizon`` bars; null if there are fewer or the close is 0."""
    return F.try_divide(F.lead("close", horizon).over(by_ticker()), F.nullif(F.col("close"), F.lit(0.0))) - 1


def cum_abnormal_return(horizon: int = 5) -> Column:
    """The sum of the abnormal returns of the next ``horizon`` bars; null unless all are there."""
    ahead = by_ticker().rowsBetween(1, horizon)
    return F.when(F.count("ar").over(ahead) == horizon, F.sum("ar").over(ahead))


def _trailing_sd(column: str, window: int, min_obs: int) -> Column:
    behind = by_ticker().rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp(column).over(behind)
    return F.when((F.count(column).over(behind) >= min_obs) & (sd > 0), sd)


def trailing_ar_vol(window: int = 60, min_obs: int = 20) -> Column:
    """Standard deviation of the last ``window`` abnormal returns, this bar's included; null below ``min_obs`` of them."""
    return _trailing_sd("ar", window, min_obs)


def realized_vol(window: int = 20, min_obs: int = 10) -> Column:
    return _trailing_sd("ret", window, min_obs)


def car_zscore(horizon: int = 5, vol_window: int = 60) -> Column:
    """The cumulative abnormal return in units of its trailing deviation over ``horizon`` bars."""
    return cum_abnormal_return(horizon) / (trailing_ar_vol(vol_window) * F.sqrt(F.lit(float(horizon))))


@dataclass(frozen=True)
class Feature:
    """A registered feature: how its column is built and whether it needs a benchmark or looks ahead."""

    name: str
    version: str
    build: Callable[..., Column]
    needs_bench: bool
    forward_looking: bool


FEATURES = {
    f.name: f
    for f in (
        Feature("forward_return", "1.0", forward_return, needs_bench=False, forward_looking=True),
        Feature("cum_abnormal_return", "1.0", cum_abnormal_return, needs_bench=True, forward_looking=True),
        Feature("car_zscore", "1.0", car_zscore, needs_bench=True, forward_looking=True),
        Feature("realized_vol", "1.0", realized_vol, needs_bench=False, forward_looking=False),
    )
}


def feature(name: str) -> Feature:
    if name not in FEATURES:
        raise KeyError(f"unknown feature {name!r}; expected one of {sorted(FEATURES)}")
    return FEATURES[name]
