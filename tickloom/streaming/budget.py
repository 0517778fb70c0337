"""The daily token budget as a live gate: each call is let through or refused by what its day has spent so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tickloom.operators.ledger import BUDGET_REPLY, HARD, SOFT

DECISIONS = "call_id long, day string, tokens long, spent_before long, refused boolean, reply string, soft_warn boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    """One counter a day, dropped by a timer once the day is over and no call of it can come any more.

    A refused call spends nothing. Within a batch calls are taken by time and id, batches as they come.
    """

    def __init__(self, soft: int, hard: int):
        self.soft, self.hard = soft, hard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "tokens long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["at", "call_id"], kind="stable")
        start = self.spent.get()[0] if self.spent.exists() else 0
        used = calls["tokens"].to_numpy()
        before = start + used.cumsum() - used
        refused = before >= self.hard
        before[refused] = before[refused][0] if refused.any() else 0
        spent = int(before[-1] if refused[-1] else before[-1] + used[-1])
        self.spent.update((spent,))
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(int(pd.Timestamp(key[0], tz="UTC").value // 10**6) + 86_400_000)
        yield pd.DataFrame(
            {
                "call_id": calls["call_id"], "day": key[0], "tokens": used, "spent_before": before, "refused": refused,
                "reply": [BUDGET_REPLY if r else None for r in refused], "soft_warn": before + used * ~refused >= self.soft,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.spent.clear()
        return iter(())

    def close(self) -> None:
        pass


def gated(calls: DataFrame, soft: int = SOFT, hard: int = HARD, delay: str = "1 hour") -> DataFrame:
    """Decisions on a stream of calls (call_id, ts, input_tokens, output_tokens); a day is closed ``delay`` after midnight.

    Missing numbers count 0; calls without a time have no day and no decision, nor have those of a closed day.
    """
    tokens = (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("long")
    timed = calls.select("call_id", F.col("ts").try_cast("timestamp").alias("at"), tokens.alias("tokens")).where("at IS NOT NULL").withWatermark("at", delay)
    days = timed.withColumn("day", F.date_format("at", "yyyy-MM-dd")).groupBy("day")
    return days.transformWithStateInPandas(Gate(soft, hard), DECISIONS, "Append", "EventTime")


def run_gate(spark: SparkSession, calls: DataFrame, out: str, checkpoint: str, soft: int = SOFT, hard: int = HARD, delay: str = "1 hour") -> StreamingQuery:
    """Decides all calls that are there and appends the decisions to ``out``, then ends; run again, it goes on from the checkpoint."""
    kept = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that this kind of state needs; read when the stream starts
    try:
        stream = gated(calls, soft, hard, delay).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        return stream.trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, kept)
