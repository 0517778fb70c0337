"""Text, JSON lines and config files."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_SUFFIXES = ("txt", "md", "markdown", "text", "log", "csv", "tsv", "json")

TOKEN_LOG = (
    "ts string, date string, requested_model string, chosen_model string, tier_reason string, tools_present boolean, "
    "n_messages long, input_tokens long, output_tokens long, latency_ms long, soft_warn boolean"
)
PROPOSAL = (
    "id string, thesis string, direction string, horizon string, universe array<string>, created_at string, "
    "trigger struct<match: struct<tickers: array<string>, entityAny: array<string>, keywordAny: array<string>>>"
)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to those in the folder."""
    rows.write.mode("append").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``schema`` (DDL); lines that aren't JSON objects of it are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_texts(spark: SparkSession, path: str, suffixes: Sequence[str] = TEXT_SUFFIXES) -> DataFrame:
    """(name, text) of every file with an allowed suffix, one row a file; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    return files.where(wanted).select(F.substring_index("path", "/", -1).alias("name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """A folder of proposals, one JSON document a file; unreadable ones are skipped, hidden files never read."""
    read = spark.read.schema(f"{PROPOSAL}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "[!.]*.json").json(path)
    return read.where("id IS NOT NULL").drop("_bad")


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """``base`` with ``over`` laid on top: maps are merged, anything else is replaced."""
    out = copy.deepcopy(dict(base))
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else copy.deepcopy(value)
    return out


def load_config(spark: SparkSession, paths: Sequence[str], default: Mapping) -> dict:
    """The first of ``paths`` (local, then seed) that reads as JSON, merged over ``default``; else the default."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            text = spark.read.text(path, wholetext=True).first()
            return deep_merge(default, json.loads(text[0]))
        except (AnalysisException, ValueError, TypeError):
            continue  # missing or not JSON: the next layer stands
    return copy.deepcopy(dict(default))


def save_config(spark: SparkSession, path: str, config: Mapping) -> None:
    """A config as one JSON text at ``path``, in place of what is there."""
    spark.createDataFrame([(json.dumps(config),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def materialise(spark: SparkSession, local: str, seed: str, default: Mapping) -> dict:
    """The config at ``local``; where it can't be read, that of ``seed`` over ``default`` is saved there first."""
    if (held := load_config(spark, [local], {})) == {}:
        save_config(spark, local, held := load_config(spark, [seed], default))
    return deep_merge(default, held)


def load_symbols(spark: SparkSession, paths: Sequence[str]) -> dict:
    """A symbol map {defaultBenchmark, tickers}."""
    from tickloom.operators.returns import DEFAULT_BENCHMARK

    return load_config(spark, paths, {"defaultBenchmark": DEFAULT_BENCHMARK, "tickers": {}})
