"""A price service as a Spark data source: read in one go, or followed as a stream whose offsets are points in time.

The service itself is a function (ticker, start, end, freq) -> frame of OHLCV rows with ``ts``; there is none built in.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tickloom.schema import BARS
from tickloom.shared import cut
from tickloom.sources.store import upsert_bars

Fetch = Callable[[str, str | None, str | None, str], pd.DataFrame | None]
NAME = "tickloom_prices"
_ARROW = pa.schema([("ticker", pa.string()), ("ts", pa.timestamp("us")), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")], ("adjusted", pa.bool_()), ("freq", pa.string())])


@dataclass
class _Ask(InputPartition):
    tickers: list[str]
    start: str | None
    end: str | None


class _Asker:
    """What both readers do: deal tickers to tasks, and turn what the service gives for one into rows."""

    def __init__(self, fetch: Fetch, options: dict):
        self.fetch, self.freq = fetch, options.get("freq", "1d")
        self.tickers = json.loads(options.get("tickers", "[]"))
        self.each = max(1, int(options.get("tickersPerTask", "1")))
        self.start, self.end = options.get("start"), options.get("end")

    def asks(self, start: str | None, end: str | None) -> list[_Ask]:
        return [_Ask(self.tickers[at : at + self.each], start, end) for at in range(0, len(self.tickers), self.each)]

    def rows(self, ask: _Ask) -> Iterator[pa.RecordBatch]:
        """Bars of the tickers within the times, both included; one that the service knows nothing of is passed over."""
        for ticker in ask.tickers:
            got = self.fetch(ticker, ask.start, ask.end, self.freq)
            if got is None or not len(got):
                continue
            ts = pd.to_datetime(got["ts"])
            kept = (ts >= pd.Timestamp(ask.start) if ask.start else True) & (ts <= pd.Timestamp(ask.end) if ask.end else True)
            frame = got.assign(ts=ts, ticker=ticker, freq=self.freq, adjusted=got["adjusted"] if "adjusted" in got else True)
            frame = frame.reindex(columns=_ARROW.names)[kept] if kept is not True else frame.reindex(columns=_ARROW.names)
            yield pa.RecordBatch.from_pandas(frame, _ARROW, preserve_index=False)


class _Batch(DataSourceReader):
    def __init__(self, asker: _Asker):
        self.asker = asker

    def partitions(self) -> Sequence[InputPartition]:
        return self.asker.asks(self.asker.start, self.asker.end) or [_Ask([], None, None)]

    def read(self, partition: _Ask) -> Iterator[pa.RecordBatch]:
        return self.asker.rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are times up to which bars were asked for. A batch asks again for ``lookback`` before it, as bars are restated.

    A batch is told by its two offsets alone, so that a replay asks for the same times.
    """

    def __init__(self, asker: _Asker, clock: Callable[[], str], lookback: float):
        self.asker, self.clock, self.lookback = asker, clock, lookback

    def initialOffset(self) -> dict:
        return {"until": self.asker.start or "1970-01-01"}

    def latestOffset(self) -> dict:
        now = self.clock()
        return {"until": min(now, self.asker.end) if self.asker.end else now}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        since = pd.Timestamp(start["until"]) - dt.timedelta(days=self.lookback)
        first = pd.Timestamp(self.asker.start or "1970-01-01")
        return self.asker.asks(max(since, first).isoformat(), end["until"]) or [_Ask([], None, None)]

    def read(self, partition: _Ask) -> Iterator[pa.RecordBatch]:
        return self.asker.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to free: the service keeps its bars."""


def _now() -> str:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(timespec="seconds")


def price_source(fetch: Fetch, clock: Callable[[], str] = _now, name: str = NAME) -> type[DataSource]:
    """A data source of that name, to be registered: ``spark.dataSource.register(price_source(fetch))``.

    Options: tickers (a JSON list), start, end, freq, tickersPerTask, and for streams lookback, in days. ``clock`` gives
    the present as ISO text.
    """

    class Prices(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return BARS

        def reader(self, schema) -> DataSourceReader:
            return _Batch(_Asker(fetch, self.options))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(_Asker(fetch, self.options), clock, float(self.options.get("lookback", "7")))

    return Prices


def _options(tickers: Sequence[str], start, end, freq: str, each: int) -> dict[str, str]:
    given = {"tickers": json.dumps(list(tickers)), "start": start, "end": end, "freq": freq, "tickersPerTask": each}
    return {k: str(v) for k, v in given.items() if v is not None}


def read_prices(spark: SparkSession, tickers: Sequence[str], start=None, end=None, freq: str = "1d", each: int = 1, name: str = NAME) -> DataFrame:
    """Bars of a registered price source."""
    return spark.read.format(name).options(**_options(tickers, start, end, freq, each)).load()


def follow_prices(spark: SparkSession, tickers: Sequence[str], store: str, checkpoint: str, start=None, freq: str = "1d", lookback: float = 7, each: int = 1, name: str = NAME) -> StreamingQuery:
    """Upserts what the service has by now and ends; run again, it goes on from the checkpoint, ``lookback`` days before where it was.

    A batch is written before it is merged, so that the service is asked once for it.
    """
    bars = spark.readStream.format(name).options(**_options(tickers, start, None, freq, each), lookback=str(lookback)).load()
    return bars.writeStream.foreachBatch(lambda batch, _: upsert_bars(cut(batch), store) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
