"""The folder that driver and executors share, and tables cut off their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, where unset a folder in the warehouse.

    Only a session that is one process (``local``, as in tests) takes a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not getattr(spark, "_tickloom_shared", None):
        one_process = spark.sparkContext.master.split("[")[0] == "local"
        spark._tickloom_shared = tempfile.mkdtemp(prefix="tickloom-") if one_process else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tickloom-scratch"
    return spark._tickloom_shared


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of a batch of texts that tasks hand to Python.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where they are larger: a batch is held some times, in the executor and in its worker."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df``: what reads it several times doesn't compute it again, nor when executors are lost."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again: less disk than a checkpoint, and columns that aren't wanted aren't read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
