"""Documents that arrive over time go through the fold once: a ledger says what was processed, and by which steps."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tickloom.operators.model_calls import TextService
from tickloom.operators.steps import Model, run_steps
from tickloom.shared import cut

_STATE = "text string, cur_type string, meta map<string,string>, dropped boolean, trace array<struct<step:string,output:string,dropped:boolean,error:string,meta:map<string,string>>>"
RESULTS = f"doc_id long, source string, content string, steps string, types array<string>, at long, {_STATE}"


def steps_version(steps: Sequence[Mapping]) -> str:
    """The steps as they are, as text; equal lists have equal versions."""
    return json.dumps(list(steps), sort_keys=True)


def changed_scope(old: Sequence[Mapping], new: Sequence[Mapping]) -> list[str] | None:
    """The document types that a step touches which is in only one of two lists, or at another place; None: all types.

    Steps that are switched off touch nothing, so that switching one on or off counts, but changing it while it is off doesn't.
    """
    live = [[s for s in steps if s.get("enabled", True)] for steps in (old, new)]
    texts = [[json.dumps(s, sort_keys=True) for s in steps] for steps in live]
    same = 0
    while same < min(map(len, texts)) and texts[0][same] == texts[1][same]:
        same += 1
    tail = 0
    while tail < min(map(len, texts)) - same and texts[0][-1 - tail] == texts[1][-1 - tail]:
        tail += 1
    scope: set[str] = set()
    for steps in live:
        for step in steps[same : len(steps) - tail]:
            kinds = (step.get("appliesTo") or {}).get("docTypes") or ["*"]
            if "*" in kinds:
                return None
            scope |= set(kinds)
    return sorted(scope)


@dataclass
class Intake:
    """Documents (doc_id, text, source) into a table of results at ``path``, one folder a batch.

    The results are the ledger: each row has the content's hash, the version of the steps, and the types that the document
    had on its way. A document is processed if its latest row has the same content and no changed step could touch it.
    A batch that is replayed replaces its own folder and nothing else.
    """

    spark: SparkSession
    path: str
    steps: Sequence[Mapping]
    model: Model | TextService

    def _rows(self, but: int | None = None) -> DataFrame:
        self.spark.createDataFrame([], RESULTS).withColumn("batch", F.lit(-1).cast("long")).write.mode("append").partitionBy("batch").parquet(self.path)
        rows = self.spark.read.schema(f"{RESULTS}, batch long").parquet(self.path)
        return rows if but is None else rows.where(F.col("batch") != but)

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("at"), F.desc("batch")))
        return rows.withColumn("__place", place).where("__place = 1").drop("__place")

    def results(self) -> DataFrame:
        """The latest state of every document."""
        return self._latest(self._rows())

    def process(self, docs: DataFrame, batch: int) -> None:
        """Runs the fold over those of ``docs`` that weren't processed as they are; of equal ids in a batch the greatest text counts."""
        docs = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("text", "source")).alias("d")).select("doc_id", "d.*")
        docs = docs.withColumn("content", F.sha2(F.concat_ws("\n", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))), 256))
        # without columns of texts, and from other batches alone: a replay finds what its first run found
        ledger = self._latest(self._rows(but=batch).select("doc_id", "content", "steps", "types", "at", "batch"))
        docs = cut(docs.join(self._done(ledger), ["doc_id", "content"], "left_anti"))
        self._write(docs, batch)

    def _done(self, ledger: DataFrame) -> DataFrame:
        """(doc_id, content) that the present steps would treat as before."""
        now = steps_version(self.steps)
        versions = [r[0] for r in ledger.select("steps").distinct().collect()]  # one for each time that steps changed
        done = F.col("steps") == now
        for version in versions:
            scope = changed_scope(json.loads(version), self.steps)
            if version != now and scope is not None:
                untouched = ~F.arrays_overlap("types", F.array(*[F.lit(x) for x in scope])) if scope else F.lit(True)
                done = done | ((F.col("steps") == version) & untouched)
        return ledger.where(done).select("doc_id", "content")

    def _write(self, docs: DataFrame, batch: int) -> None:
        out = run_steps(docs, self.steps, self.model, F.col("source"))
        seen = F.filter(F.transform("trace", lambda e: F.try_element_at(e["meta"], F.lit("docType"))), lambda x: x.isNotNull())
        types = F.array_compact(F.array_distinct(F.concat(F.array("source"), seen)))
        made = out.select("doc_id", "source", "content", F.lit(steps_version(self.steps)).alias("steps"), types.alias("types"), F.lit(batch).cast("long").alias("at"), "text", "cur_type", "meta", "dropped", "trace")
        made.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def follow(self, incoming: str, schema: str, checkpoint: str) -> StreamingQuery:
        """Processes every new Parquet file of documents once, then ends; run again, it goes on from the checkpoint.

        Batches count from the checkpoint's beginning, so a folder of results belongs to one checkpoint.
        """
        stream = self.spark.readStream.schema(schema).parquet(incoming)
        return stream.writeStream.foreachBatch(lambda docs, n: self.process(docs, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
