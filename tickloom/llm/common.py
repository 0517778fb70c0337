"""What the operators of this subpackage share: tables, the shared folder, checkpoints and row identity."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of a batch that goes to a Python worker, so that wide or long rows don't make large ones.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, where unset one in the warehouse.

    Only a session that is one process (``local``, as in tests) takes a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not getattr(spark, "_tickloom_dir", None):
        one_process = spark.sparkContext.master.split("[")[0] == "local"
        spark._tickloom_dir = tempfile.mkdtemp(prefix="tickloom-") if one_process else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tickloom-scratch"
    return spark._tickloom_dir


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_ROWS and BATCH_BYTES where they are larger.

    Operators that hand texts to Python call it: a batch is held once in the executor and some times in its worker.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df``: later reads don't recompute it and survive lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: compact, columnar, and off the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed inner names, so that extra or clashing columns of the input don't matter."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A table of so many rows of a few numbers (under 100 bytes each) is small enough to broadcast.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def place(df: DataFrame, name: str) -> int:
    """Where the column ``name`` stands in the rows of ``df``."""
    return [c.lower() for c in df.columns].index(name.lower())


def parts_for(spark: SparkSession, rows_or_bytes: int, each: int) -> int:
    """Partitions so that each gets about ``each``, and no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows_or_bytes / each))


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the fold of a document. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
