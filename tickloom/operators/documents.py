"""Documents on their way to the extractors: tokens by model, buckets, and the link to tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import token_estimate


def bucket_tokens(docs: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """(model, items, tokens): how many documents and estimated tokens go to each model."""
    return docs.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("items"), F.sum(token_estimate(F.col(text))).alias("tokens"))


def write_buckets(docs: DataFrame, path: str, model: str = "model") -> None:
    """Documents as Parquet, a folder for each model; no shuffle, so a model that takes most rows is written by all tasks."""
    docs.write.mode("overwrite").partitionBy(model).parquet(path)
