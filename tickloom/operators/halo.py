"""Windows over the bars of a ticker without a task that holds them all: buckets of consecutive bars with a halo on either side.

A bar's place in its ticker is counted over sampled ranges; so many places make a bucket. A bar also goes to each bucket
in which some bar's window reaches it. Halos are counted in bars, so gaps in time don't matter, and each bar is owned
by one bucket: features are computed in all, and kept where the bar is owned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ranks import running

#: Bars of a ticker up to which it stays whole; also the bars of a bucket.
ROWS = 500_000
#: So many names of hot tickers are broadcast; more are joined.
NAMES = 10_000
_WHOLE, _OWN = "__whole", "__own"


def spread(bars: DataFrame, before: int, after: int, rows: int = ROWS) -> DataFrame:
    """``bars`` (ticker, ts, ...) with tickers of more than ``rows`` bars in buckets, as if each were a ticker.

    Windows over ``ticker`` that reach ``before`` bars back and ``after`` ahead then see all they need in the bars that are
    owned; owned() brings these back. Without such tickers ``bars`` stay as they are. They are counted first, so should be
    written before.
    """
    if bars.count() <= rows:  # so few in all that none can be hot; a count needs no shuffle
        return bars
    hot = bars.groupBy(F.col("ticker").alias("__hot")).count().where(F.col("count") > rows).select("__hot")
    n = hot.count()
    if not n:
        return bars
    names = F.broadcast(hot) if n <= NAMES else hot
    same = bars["ticker"] == names["__hot"]
    copies = in_buckets(numbered(bars.join(names, same, "left_semi")), before, after, rows).drop("__bucket")
    rest = bars.join(names, same, "left_anti").withColumn(_WHOLE, F.col("ticker")).withColumn(_OWN, F.lit(True))
    return rest.unionByName(copies)


def numbered(bars: DataFrame) -> DataFrame:
    """``bars`` with ``__n``, the place of each in its ticker, from 0."""
    return running(bars, F.sum, F.lit(1).cast("long"), ["ts"], "__n", ["ticker"]).withColumn("__n", F.col("__n") - 1)


def bucket_of(place: Column, rows: int) -> Column:
    return F.floor(place / F.lit(rows)).cast("long")


def in_buckets(placed: DataFrame, before: int, after: int, rows: int) -> DataFrame:
    """Bars of numbered() in each ``__bucket`` of ``rows`` bars that they are of, or in the halo of, under a ticker of its own."""
    at = F.col("__n")
    copies = placed.withColumn("__bucket", F.explode(F.sequence(F.greatest(bucket_of(at - after, rows), F.lit(0).cast("long")), bucket_of(at + before, rows))))
    copies = copies.withColumn(_WHOLE, F.col("ticker")).withColumn(_OWN, F.col("__bucket") == bucket_of(at, rows))
    return copies.withColumn("ticker", F.concat("ticker", F.lit("\0"), F.col("__bucket").cast("string"))).drop("__n")


def owned(frame: DataFrame) -> DataFrame:
    """The bars of spread() once each, under their ticker; other frames stay as they are."""
    if _WHOLE not in frame.columns:
        return frame
    names = [c for c in frame.columns if c not in (_WHOLE, _OWN)]
    return frame.where(_OWN).select(*[F.col(_WHOLE).alias("ticker") if c == "ticker" else F.col(c) for c in names])
