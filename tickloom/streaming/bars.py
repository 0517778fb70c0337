"""Rolling capture: files of bars that arrive are upserted, so late and restated bars replace what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.schema import BARS
from tickloom.sources.files import TOKEN_LOG
from tickloom.sources.store import upsert_bars


def capture(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Upserts every new Parquet file of bars once, then ends; run again, it goes on from the checkpoint.

    An upsert gives the same store if it is repeated, so a batch that failed half way can run again. There is no
    watermark: a later file wins, however old its bars.
    """
    bars = spark.readStream.schema(BARS).parquet(incoming)
    return bars.writeStream.foreachBatch(lambda batch, _: upsert_bars(batch, store) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_tokens(spark: SparkSession, log: str, delay: str = "1 day") -> DataFrame:
    """A stream of (day, tokens) from a folder of JSON token logs, by the day of ``ts``; a day closes ``delay`` after it."""
    rows = spark.readStream.schema(TOKEN_LOG).option("mode", "DROPMALFORMED").json(log)
    timed = rows.withColumn("at", F.col("ts").try_cast("timestamp")).where("at IS NOT NULL").withWatermark("at", delay)
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return timed.groupBy(F.window("at", "1 day")).agg(F.sum(used).cast("long").alias("tokens")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "tokens")


def session_counts(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions (user_id, start, end, n) of a stream of events (user_id, ts); an extra beside the bar capture."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
