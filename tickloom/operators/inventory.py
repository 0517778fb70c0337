"""Dataset integrity: sizes, hashes and row counts of files against the snapshot before."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.shared import cut

#: Percent by which a file's rows may change unremarked.
DRIFT_PERCENT = 1.0
#: Bytes that a worker holds of a file.
CHUNK = 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and its root there; Spark writes local paths with one slash."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime) of every file under ``path``, relative to it; files whose name begins with a dot are left out.

    Folders are listed by tasks, one level after the other; only the number of folders found comes back.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = _opened(path)
        for frame in frames:
            for folder in frame["path"]:
                found = at.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{folder}"))
                rows = [(f"{folder}/{e.base_name}".lstrip("/"), e.type == fs.FileType.Directory, e.size or 0, (e.mtime_ns or 0) // 1000) for e in found]
                yield pd.DataFrame(rows, columns=["path", "folder", "size", "micros"])

    level, files = spark.createDataFrame([("",)], "path string"), None
    while True:
        found = cut(level.repartition(tasks, "path").mapInPandas(entries, "path string, folder boolean, size long, micros long"))
        here = found.where("NOT folder")
        files = here if files is None else files.unionAll(here)
        level = found.where("folder").select("path")
        if level.isEmpty():
            break
    kept = files.where(~F.substring_index("path", "/", -1).startswith("."))
    return kept.select("path", "size", F.timestamp_micros("micros").alias("mtime"))


def read_files(files: DataFrame, path: str) -> DataFrame:
    """(path, sha256, rows) of ``files`` (path): a file is streamed through its hash, a chunk at a time, so its size doesn't matter.

    rows are lines, as they end by line feed, carriage return or both; of ``*.jsonl`` only, else null.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = _opened(path)
        for frame in frames:
            for name in frame["path"]:
                digest, lines, last = hashlib.sha256(), 0, b""
                with at.open_input_stream(f"{root.rstrip('/')}/{name}") as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                        if name.endswith(".jsonl"):
                            lines += chunk.count(b"\n") + chunk.count(b"\r") - chunk.count(b"\r\n") - (last == b"\r" and chunk[:1] == b"\n")
                            last = chunk[-1:]
                lines += last not in (b"", b"\n", b"\r")
                yield pd.DataFrame({"path": [name], "sha256": [digest.hexdigest()], "rows": pd.Series([lines if name.endswith(".jsonl") else None], dtype="Int64")})

    return files.select("path").repartition(tasks, "path").mapInPandas(read, "path string, sha256 string, rows long")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, rows) of every non-empty ``*.jsonl`` file under ``path``. Files are split, so a large one is counted by many tasks."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return lines.select(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")).alias("path")).groupBy("path").agg(F.count("*").alias("rows"))


def snapshot(spark: SparkSession, path: str, previous: DataFrame | None = None) -> DataFrame:
    """(path, size, mtime, sha256, rows) of every file under ``path``, by path; paths are relative to it, hidden files left out.

    An empty file's hash is ``""``; rows are counted for ``*.jsonl`` only. A file as old as in ``previous`` isn't read: it keeps
    its hash and rows.
    """
    listed = list_files(spark, path)
    wanted = listed.where("size > 0")
    if previous is not None:
        known = listed.join(previous.select("path", "mtime", "sha256", "rows"), ["path", "mtime"]).select("path", "sha256", "rows")
        found = read_files(wanted.join(known, "path", "left_anti"), path).unionByName(known)
    else:
        found = read_files(wanted, path)
    out = listed.join(cut(found), "path", "left")
    rows = F.when(F.col("path").endswith(".jsonl"), F.coalesce("rows", F.lit(0).cast("long")))
    return out.select("path", "size", "mtime", F.coalesce("sha256", F.lit("")).alias("sha256"), rows.alias("rows")).orderBy("path")


def compare(current: DataFrame, previous: DataFrame, percent: float = DRIFT_PERCENT) -> DataFrame:
    """``current`` (path, size, rows) with prev_rows, drift in percent and the anomaly, if any: ZERO-BYTE or ROW-DRIFT."""
    before = previous.select(F.col("path").alias("__path"), F.col("rows").alias("prev_rows"))
    joined = current.join(before, current["path"] == before["__path"], "left").drop("__path")
    drift = F.when(F.col("prev_rows") > 0, F.abs(F.col("rows") - F.col("prev_rows")) / F.col("prev_rows") * 100)
    return joined.withColumn("drift", drift).withColumn("anomaly", F.when(F.col("size") == 0, "ZERO-BYTE").when(F.col("drift") > percent, "ROW-DRIFT"))


def exit_code(counted: DataFrame) -> DataFrame:
    """One row (code) over that of anomalies(): 0 clean, 1 with anomalies, 2 without any file."""
    return counted.select(F.when(F.col("files") == 0, 2).when(F.col("zero_bytes") + F.col("drifts") > 0, 1).otherwise(0).alias("code"))


def anomalies(compared: DataFrame) -> DataFrame:
    """One row (files, zero_bytes, drifts). An empty file that also drifted counts in both."""
    return compared.agg(F.count("*").alias("files"), F.count_if(F.col("size") == 0).alias("zero_bytes"), F.count_if(F.coalesce(F.col("drift") > DRIFT_PERCENT, F.lit(False))).alias("drifts"))
