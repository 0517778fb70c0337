"""The weekly sweep: events ranked by how unusual their move was and how recent they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.dates import recency
from tickloom.functions.prices import car_zscore
from tickloom.functions.text import after_prefix
from tickloom.operators.asof import asof_join
from tickloom.operators.events import ASOF, TICKER
from tickloom.operators.returns import featured

#: Weights of the move and of recency in a score.
W_MOVE, W_RECENCY = 1.0, 0.5


def scored_events(bars: DataFrame, events: DataFrame, today, horizon: int = 5, vol_window: int = 60) -> DataFrame:
    """``events`` (ticker, as_of text) with z and score; an event without z counts by its recency alone."""
    frame = featured(bars, horizon=horizon, window=vol_window, z=car_zscore(horizon, vol_window)).select("ticker", "ts", "z")
    timed = events.withColumn("__at", F.col("as_of").try_cast("timestamp_ntz"))
    z = asof_join(timed, frame, ["ticker"], "__at", "ts", ["z"]).drop("__at")
    return z.withColumn("score", F.lit(W_MOVE) * F.coalesce(F.abs("z"), F.lit(0.0)) + F.lit(W_RECENCY) * recency(F.col("as_of"), F.lit(today)))


def best_by_ticker(scored: DataFrame, digits: int = 9) -> DataFrame:
    """The event of the highest score of each ticker, the earliest on a tie; ties are judged on ``digits`` decimals."""
    best = scored.groupBy("ticker").agg(F.max_by(F.struct("as_of", "z", "score"), F.struct(F.round("score", digits), -F.unix_date(F.coalesce(F.col("as_of").try_cast("date"), F.lit("9999-12-31").cast("date"))), F.col("as_of"))).alias("b"))
    return best.select("ticker", "b.*")


def top(scored: DataFrame, n: int = 3) -> DataFrame:
    return best_by_ticker(scored).orderBy(F.desc(F.round("score", 9)), "ticker").limit(n)


def chunk_of(tags: DataFrame, vertices: DataFrame, picks: DataFrame, length: int = 600) -> DataFrame:
    """``picks`` (ticker, as_of) with ``chunk``: the start of the text of the least node that has both tags, or ``""``."""
    sides = [tags.where(F.col("tag").startswith(p)).select("node_id", after_prefix(F.col("tag"), p).alias(n)) for p, n in ((TICKER, "ticker"), (ASOF, "as_of"))]
    nodes = sides[0].join(picks.select("ticker").distinct(), "ticker", "left_semi").join(sides[1], "node_id").join(picks.select("ticker", "as_of"), ["ticker", "as_of"], "left_semi")
    least = nodes.groupBy("ticker", "as_of").agg(F.min("node_id").alias("id"))
    texts = least.join(vertices.select("id", "text"), "id").select("ticker", "as_of", F.left("text", F.lit(length)).alias("chunk"))
    return picks.join(texts, ["ticker", "as_of"], "left").withColumn("chunk", F.coalesce("chunk", F.lit("")))


def recent_per_key(df: DataFrame, key: str, order: list, n: int = 20) -> DataFrame:
    """The first ``n`` rows of each key in ``order``. Spark drops the rest before the shuffle, so a hot key stays small."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
