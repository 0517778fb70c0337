"""Text-model steps by a service: every text is asked once, in batches, and errors leave documents as they are.

Answers are kept in a table by a hash of text, step and service version. A step asks only for texts that have no answer
there, so that equal texts, later steps' reruns and a changed pipeline don't ask again for what is known.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooSlow
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shared import written

#: An answer; ``row`` is the document whose text was asked, where documents have numbers.
_ROW = "key string, row long, output string, error string"
#: Bytes of bitmaps and of copies that are broadcast to texts and answers; more are joined.
BROADCAST_BYTES = 64 << 20


class Client(Protocol):
    """What a service's connect() gives: one answer for each text, or an exception."""

    def ask(self, texts: list[str], step: Mapping) -> list[str | None]: ...


@dataclass(frozen=True)
class TextService:
    """How texts are asked: ``connect`` makes a client in each task, ``store`` is the folder of answers.

    A batch that fails or takes longer than ``timeout`` seconds is asked again ``retries`` times, ``pause`` seconds apart,
    then text by text, so that one bad text doesn't fail its neighbours. ``version`` names the model: another one knows no answers.
    """

    connect: Callable[[], Client]
    store: str
    version: str = "1"
    batch: int = 16
    timeout: float = 60.0
    retries: int = 2
    pause: float = 0.5
    tasks: int | None = None
    asks: tuple[str, ...] = field(default=("prompt", "output", "kind", "labels", "model"))

    def key(self, text: Column, step: Mapping) -> Column:
        """The hash under which an answer is kept: of what is sent, not of the step's name or scope."""
        asked = json.dumps([self.version, *[step.get(k) for k in self.asks]], sort_keys=True)
        return F.sha2(F.concat(F.lit(asked + "\n"), text), 256)


class _Asker:
    """A client with time limit and retries. A call that hangs is left behind, with its client."""

    def __init__(self, service: TextService, step: Mapping):
        self.service, self.step, self.client = service, step, service.connect()
        self.pool = ThreadPoolExecutor(1)

    def once(self, texts: list[str]) -> list[str | None]:
        try:
            answers = self.pool.submit(self.client.ask, texts, self.step).result(self.service.timeout)
        except TooSlow:
            self.pool.shutdown(wait=False)
            self.client, self.pool = self.service.connect(), ThreadPoolExecutor(1)
            raise TimeoutError(f"no answer within {self.service.timeout} s") from None
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
        return answers

    def ask(self, texts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each text."""
        for attempt in range(self.service.retries + 1):
            try:
                return [(a, None) for a in self.once(texts)]
            except Exception as e:  # whatever a client raises; the documents stay as they are
                error = f"{type(e).__name__}: {e}"
            if attempt < self.service.retries:
                time.sleep(self.service.pause)
        if len(texts) == 1:
            return [(None, error)]
        return [self.ask([t])[0] for t in texts]


def _stored(service: TextService, spark: SparkSession) -> DataFrame:
    return spark.read.schema(f"{_ROW}, run string").parquet(service.store)


def _wanted(texts: DataFrame, step: Mapping, service: TextService) -> DataFrame:
    """(key, text) of each different text once, dealt by key; copies are left out before that one shuffle of texts."""
    return texts.where("text IS NOT NULL").select(service.key(F.col("text"), step).alias("key"), "text").groupBy("key").agg(F.first("text").alias("text"))


def answers(texts: DataFrame, step: Mapping, service: TextService) -> DataFrame:
    """(key, output, error) for every different text of ``texts`` (text); the store has those that were answered.

    New answers are written once, so that later plans don't ask again. A task that is run again asks its texts again;
    only one attempt's answers are kept.
    """
    wanted = _wanted(texts, step, service)
    run = _ask(wanted.join(_known(texts.sparkSession, service), "key", "left_anti").withColumn("row", F.lit(None).cast("long")), step, service)
    return wanted.select("key").join(_best(texts.sparkSession, service, run, F.col("output").alias("output")), "key").select("key", "output", "error")


def _known(spark: SparkSession, service: TextService) -> DataFrame:
    """Keys of texts that were answered."""
    spark.createDataFrame([], f"{_ROW}, run string").write.mode("append").parquet(service.store)
    return _stored(service, spark).where("error IS NULL").select("key")


def _ask(new: DataFrame, step: Mapping, service: TextService) -> str:
    """Asks for ``new`` (key, row, text) and appends the answers to the store; the run under which they stand there."""
    run = uuid.uuid4().hex

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker = None
        for frame in frames:
            for at in range(0, len(frame), service.batch):
                part = frame.iloc[at : at + service.batch]
                asker = asker or _Asker(service, step)
                found = asker.ask(part["text"].tolist())
                yield pd.DataFrame({"key": part["key"], "row": part["row"], "output": [a for a, _ in found], "error": [e for _, e in found]})

    new = new.repartition(service.tasks, "key") if service.tasks else new
    new.select("key", "row", "text").mapInPandas(ask, _ROW).withColumn("run", F.lit(run)).write.mode("append").option("compression", "zstd").parquet(service.store)
    return run


def _best(spark: SparkSession, service: TextService, run: str, *shown: Column) -> DataFrame:
    """(key, run, row, error) of the answer of each key, with what is ``shown`` of it: one of this run, else one that was there.

    The same text may have been answered by two runs at a time. Outputs that aren't shown aren't read.
    """
    rank = F.struct(F.col("error").isNull().alias("answered"), (F.col("run") == run).alias("own"), "run", "row", "error", *shown)
    made = _stored(service, spark).where(F.col("error").isNull() | (F.col("run") == run)).select("key", rank.alias("a"))
    return made.groupBy("key").agg(F.max("a").alias("a")).select("key", "a.*").drop("answered", "own")


def near(rows: DataFrame, each: int) -> DataFrame:
    """``rows`` to be broadcast, if they are few at ``each`` bytes a row."""
    return F.broadcast(rows) if rows.count() * each <= BROADCAST_BYTES else rows


def split(texts: DataFrame, rows: DataFrame, among: bool) -> DataFrame:
    """Those of ``texts`` (row, text) that are ``among`` ``rows`` (row), or that aren't. Texts stay where they are: a bit a document is broadcast."""
    number = F.col("row") + 1
    bits = rows.groupBy(F.bitmap_bucket_number(number).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits"))
    held = texts.withColumn("__place", F.bitmap_bit_position(number)).join(near(bits, 4096), F.bitmap_bucket_number(number) == F.col("__bucket"), "left")
    marked = F.expr("coalesce(shiftright(cast(conv(hex(substring(__bits, cast(__place div 8 as int) + 1, 1)), 16, 10) as int), cast(__place % 8 as int)) & 1, 0) = 1")
    return held.where(marked if among else ~marked).select("row", "text")


def ask_rows(wanted: DataFrame, texts: DataFrame, step: Mapping, service: TextService) -> str:
    """Asks for each different key of ``wanted`` (key, row) that has no answer, once, with the text of its first row in ``texts`` (row, text).

    Only keys and numbers of documents are shuffled; texts are asked where they are.
    """
    new = wanted.groupBy("key").agg(F.min("row").alias("row")).join(_known(texts.sparkSession, service), "key", "left_anti")
    return _ask(split(texts, written(new.select("row"), "asked"), True).withColumn("key", service.key(F.col("text"), step)), step, service)


def rewritten(changed: DataFrame, texts: DataFrame, service: TextService, run: str, kept: Column) -> DataFrame:
    """``texts`` (row, text) with those of ``changed`` (row, key, run, first) replaced by their answers, or left out where those aren't ``kept``.

    ``first`` is the row that was asked. Its answer has its number and is read from the store as it is; only other rows, copies or known
    before, are joined with answers by key.
    """
    changed = written(changed, "changed")
    stored = _stored(service, texts.sparkSession).where(F.col("error").isNull() & F.col("output").isNotNull() & kept)
    own = stored.where((F.col("run") == run) & F.col("row").isNotNull()).select("row", F.col("output").alias("text"))
    others = changed.where((F.col("run") != run) | ~F.col("row").eqNullSafe(F.col("first"))).select("row", "key", "run")
    copied = stored.select("key", "run", F.col("output").alias("text")).join(near(others, 160), ["key", "run"]).select("row", "text")
    return split(texts, changed.select("row"), False).unionByName(own).unionByName(copied)
