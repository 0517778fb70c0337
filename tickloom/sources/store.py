"""The bar store: Parquet partitioned by freq and ticker, with latest-wins upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schema import BARS, check_freq, normalise
from tickloom.shared import cut
from tickloom.sources.bars import make_adapter, within

PARTITIONS = ("freq", "ticker")


def empty_bars(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the store has been written, asked of the file system that the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # with the schema given, ``freq=1d`` isn't inferred as the double 1.0
    return spark.read.schema(BARS).parquet(path).select(BARS.names) if _exists(spark, path) else empty_bars(spark)


def latest_wins(existing: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Both tables with one row for each (freq, ticker, ts): the new one's, and of several new ones the last by ``order``.

    Without ``order`` the greatest row of equal (freq, ticker, ts) within a batch stands, so reruns agree.
    """
    rank = F.col(order) if order else F.lit(0)
    both = existing.withColumns({"__batch": F.lit(0), "__rank": F.lit(None).cast(new.select(rank.alias("r")).schema["r"].dataType)}).unionByName(new.withColumns({"__batch": F.lit(1), "__rank": rank}).select(*existing.columns, "__batch", "__rank"))
    rest = [c for c in existing.columns if c not in ("freq", "ticker", "ts")]
    best = both.groupBy("freq", "ticker", "ts").agg(F.max_by(F.struct(*rest), F.struct("__batch", "__rank", *rest)).alias("__row"))
    return best.select("freq", "ticker", "ts", "__row.*").select(existing.columns)


def upsert_bars(bars: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """Merges ``bars`` into the store and returns (ticker, freq, rows): the rows now held for each pair that was touched.

    Only partitions of the batch's (freq, ticker) pairs are read (dynamic partition pruning through the semi join) and
    only they are replaced. An unknown freq fails before anything is written. ``order`` names a column of ``bars`` by
    which the last of rows with equal (freq, ticker, ts) is told.
    """
    spark = bars.sparkSession
    new = check_freq(normalise(bars).withColumn("__order", bars[order])) if order else check_freq(normalise(bars))
    touched = new.select(*PARTITIONS).distinct()
    known = _stored(spark, path).join(touched, list(PARTITIONS), "left_semi").select(BARS.names)
    merged = latest_wins(known, new, "__order" if order else None)
    keys = cut(touched)  # names only; the batch may not be readable twice
    merged.repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    held = _stored(spark, path).join(keys, list(PARTITIONS), "left_semi")
    return held.groupBy("ticker", "freq").agg(F.count("*").alias("rows"))


def summary(detail: DataFrame) -> DataFrame:
    """One row (tickers, rows) over the detail of an upsert."""
    return detail.agg(F.count("*").alias("tickers"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def read_bars(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, freq: str = "1d", start=None, end=None, ordered: bool = False) -> DataFrame:
    """Bars of one freq; no tickers means all, no store means none. Freq and tickers prune partitions, times are pushed down."""
    bars = within(_stored(spark, path).where(F.col("freq") == freq), tickers, start, end)
    return bars.orderBy("ticker", "ts") if ordered else bars


def close_series(spark: SparkSession, path: str, tickers: Sequence[str] | None = None, freq: str = "1d", start=None, end=None) -> DataFrame:
    return read_bars(spark, path, tickers, freq, start, end).select("ticker", "ts", "close")


def coverage(bars: DataFrame) -> DataFrame:
    """(ticker, rows, first, last, adjusted) for each ticker, in order."""
    return bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.bool_and("adjusted").alias("adjusted")).orderBy("ticker")


def ingest(spark: SparkSession, spec: Mapping, path: str, tickers: Sequence[str] | None = None, start=None, end=None, freq: str = "1d") -> DataFrame:
    """Bars of an adapter's config into the store; what came out of it, as from upsert_bars."""
    return upsert_bars(make_adapter(spec).load_history(spark, tickers, start=start, end=end, freq=freq), path)
