"""Features kept up as bars are upserted: only what a changed bar reaches is computed again.

A changed close alters its own return and the next one, and through a benchmark the abnormal returns of all tickers on it on
those days. From there a window reaches so many bars ahead and a horizon so many back. Bars are numbered in their ticker and
cut into buckets; a bucket with anything in reach is computed again, with its halo, and its rows replace the older ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.halo import bucket_of, in_buckets, numbered, owned
from tickloom.operators.returns import with_features, with_returns
from tickloom.shared import cut

#: Bars of a bucket.
ROWS = 512


@dataclass
class FeatureTable:
    """Features of every bar at ``path``: ret, ar and ``features``, which reach ``window`` bars back and ``horizon`` ahead at most."""

    spark: SparkSession
    path: str
    features: Mapping[str, Column]
    horizon: int = 5
    window: int = 60
    beta: float = 1.0
    rows: int = ROWS

    def update(self, bars: DataFrame, changed: DataFrame) -> int:
        """Brings the table up to ``bars`` (ticker, ts, close, bench), as they are after ``changed`` (ticker, ts) were upserted.

        Returns how many bars were computed again. The same update once more gives the same table. ``bars`` should be the
        store's, partitioned by ticker: only tickers in reach are numbered.
        """
        changed = cut(changed.select("ticker", "ts").distinct())
        names = changed.select("ticker").distinct()
        on_them = bars.select("ticker", "bench").distinct().join(names.select(F.col("ticker").alias("bench")), "bench", "left_semi").select("ticker")
        near = bars.join(names.unionAll(on_them).distinct(), "ticker", "left_semi")
        placed = cut(numbered(near.select("ticker", "ts", "close", "bench")))
        dirty = cut(self._dirty(placed, changed))
        first, last = bucket_of(F.greatest(F.col("__n") - self.horizon, F.lit(0)), self.rows), bucket_of(F.col("__n") + self.window - 1, self.rows)
        buckets = dirty.select(F.col("ticker").alias("__whole"), F.explode(F.sequence(first, last)).alias("__bucket")).distinct()
        copies = in_buckets(placed, max(self.window, 1), self.horizon, self.rows).join(buckets, ["__whole", "__bucket"], "left_semi").drop("__bucket")
        benches = bars.join(placed.select(F.col("bench").alias("ticker")).distinct(), "ticker", "left_semi").select("ticker", "ts", "close")
        made = owned(with_features(with_returns(copies, benches, beta=self.beta), **self.features))
        seq = self._last() + 1
        made.select("ticker", "ts", "ret", "ar", *self.features, F.lit(seq).cast("long").alias("seq")).write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path).where(F.col("seq") == seq).count()

    @staticmethod
    def _dirty(placed: DataFrame, changed: DataFrame) -> DataFrame:
        """(ticker, __n) of bars whose close, return or abnormal return may be another."""
        here = placed.join(changed, ["ticker", "ts"], "left_semi").select("ticker", "__n")
        returns = here.unionAll(here.withColumn("__n", F.col("__n") + 1)).distinct()
        days = placed.join(returns, ["ticker", "__n"], "left_semi").select(F.col("ticker").alias("bench"), "ts")
        return returns.unionAll(placed.join(days, ["bench", "ts"], "left_semi").select("ticker", "__n")).distinct()

    def _last(self) -> int:
        try:
            return self.spark.read.parquet(self.path).agg(F.max("seq")).first()[0] or 0
        except Exception as e:  # the reader has no narrower class for a missing path
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def read(self) -> DataFrame:
        """(ticker, ts, ret, ar, features): every bar's as they were last computed."""
        values = F.struct("ret", "ar", *self.features)
        return self.spark.read.parquet(self.path).groupBy("ticker", "ts").agg(F.max_by(values, "seq").alias("v")).select("ticker", "ts", "v.*")
