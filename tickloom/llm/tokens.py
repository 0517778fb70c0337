"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed rows. A batch of inserts, deletes and revisions is
turned into such rows: a delete takes back what the ledger holds for the document, a revision does so and adds the new
count. Every batch writes one partition of the ledger and one of the totals and overwrites only these, and it reads
only earlier batches: committing a batch again changes nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import small_batches, unused

KEYS = ("source", "lang", "version")
_LEDGER = "doc_id long, source string, lang string, version string, docs long, tokens long, batch long, bucket int"
#: Parts of a batch's ledger, by a hash of doc_id: a small batch of changes reads only the parts that its ids can be in.
#: So many tasks write a part, as rows without an id are all in one.
BUCKETS, WRITERS = 64, 16
_TOTALS = "source string, lang string, version string, docs long, tokens long, batch long"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def with_tokens(docs: DataFrame, ranks_path: str, pattern: str, texts: Mapping[str, str] | None = None, keep: bool = True) -> DataFrame:
    """``docs`` with the number of byte-pair tokens of whole texts (null: 0).

    ``texts`` names the new columns and the text column of each, by default ``tokens`` of ``text``; with ``keep=False``
    the text columns are left out. A column of ``docs`` that is called like a new one gives way to it. The vocabulary file is read on the driver and broadcast; it is a few MB whatever the corpus.
    """
    small_batches(docs.sparkSession)
    texts = dict(texts or {"tokens": "text"})
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    new = {c.lower() for c in texts}
    rest = [docs[c] for c in docs.columns if c.lower() not in new and (keep or c not in texts.values())]
    n = len(rest)  # columns can't go to the tasks
    given = docs.select(*rest, *[docs[c].alias(unused(docs, f"text_{k}")) for k, c in enumerate(texts.values())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(shared.value, pattern).encode_ordinary
        for batch in batches:
            tokens = [pa.array([len(encode(t.as_py())) if t.is_valid else 0 for t in column], pa.int64()) for column in batch.columns[n:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *tokens], [*batch.schema.names[:n], *texts])

    return given.mapInArrow(count, T.StructType([*given.schema.fields[:n], *(T.StructField(c, T.LongType()) for c in texts)]))


class TokenRollup:
    """The rollup in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.ledger_path, self.totals_path = spark, f"{folder}/ledger", f"{folder}/totals"
        for path, schema, parts in ((self.ledger_path, _LEDGER, ["batch", "bucket"]), (self.totals_path, _TOTALS, ["batch"])):
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(path)

    def _read(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path).where("batch IS NOT NULL")

    def _write(self, rows: DataFrame, path: str, batch: int, *parts: str) -> None:
        """The rows of a batch in place of those that it wrote before; other batches aren't touched."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).parquet(f"{path}/batch={batch}")

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Applies changes (op, doc_id, source, lang, version, tokens); op is insert, delete or revise.

        An insert adds its row, however often its id is there. A delete or a revision takes back all rows that earlier
        batches hold for its doc_id and version, once a batch, and nothing if there are none; a revision then adds its row.
        Rows with another op or a null version, and deletes and revisions without an id, take nothing back. An empty batch
        leaves an empty partition in place of an earlier one. Batches are to be committed in order: one sent again after
        later ones doesn't change what these took back. The ledger is written before the totals; where that was cut short, the
        batch sent again makes both right.
        """
        bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
        gone = changes.where("op IN ('delete', 'revise')").select(F.col("doc_id").cast("long").alias("doc_id"), "version").distinct().withColumn("bucket", bucket)
        held = self._read(self.ledger_path, _LEDGER).where(F.col("batch") < batch).join(gone, ["bucket", "doc_id", "version"])
        held = held.groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        back = held.select("doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        new = changes.where("op IN ('insert', 'revise')").select("doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long"))
        # a row without meaning keeps the partition there when the batch is empty
        none = self.spark.createDataFrame([(None, None, None, None, 0, 0)], "doc_id long, source string, lang string, version string, docs long, tokens long")
        # rows of an id add up, so that however many there are they become one; different ones are dealt by what they hold,
        # so that a task that runs again deals them alike
        rows = back.unionByName(new).unionByName(none).groupBy("doc_id", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).withColumn("bucket", bucket)
        rows = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id", *KEYS), F.lit(WRITERS)))
        self._write(rows, self.ledger_path, batch, "bucket")
        mine = self._read(self.ledger_path, _LEDGER).where(F.col("batch") == batch)
        self._write(mine.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), self.totals_path, batch)

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all batches, without keys that hold nothing any more."""
        sums = self._read(self.totals_path, _TOTALS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")
