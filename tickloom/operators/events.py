"""Events from tags: pairs of ticker and date on a shared node, and the filters of a trigger."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import after_prefix
from tickloom.operators.text_index import TextIndex, node_text

TICKER, ASOF = "ticker:", "asof:"


def events_from_tags(tags: DataFrame) -> DataFrame:
    """Distinct (ticker, as_of) of tags (node_id, tag) that share a node; as_of is text.

    A node's tags are gathered into two sets first, so the table is shuffled once; a node has few tags.
    """
    ticker, as_of = after_prefix(F.col("tag"), TICKER), after_prefix(F.col("tag"), ASOF)
    nodes = tags.groupBy("node_id").agg(F.collect_set(ticker).alias("tickers"), F.collect_set(as_of).alias("dates"))
    return nodes.select(F.explode("tickers").alias("ticker"), "dates").select("ticker", F.explode("dates").alias("as_of")).distinct()


def matches(tags: DataFrame, vertices: DataFrame | TextIndex, words: list[str]) -> DataFrame:
    """Tickers (ticker) for which a tagged node's name or text contains any of ``words``, whatever the case.

    Matching is by ticker, not by event. The texts of a ticker are searched where they are, never joined into one; where
    vertices are indexed, only texts that may hold a word are.
    """
    if isinstance(vertices, TextIndex):
        hits = vertices.search(vertices.spark.createDataFrame([(w,) for w in words], "word string")).select(F.col("id").alias("node_id")).distinct()
    else:
        found = F.lit(False)
        for word in words:
            found = found | node_text().contains(word.lower())
        hits = vertices.where(found).select(F.col("id").alias("node_id"))
    return tags.where(F.col("tag").startswith(TICKER)).join(hits, "node_id", "left_semi").select(after_prefix(F.col("tag"), TICKER).alias("ticker")).distinct()


def triggered(events: DataFrame, match: Mapping[str, list[str]], tags: DataFrame | None = None, vertices: DataFrame | TextIndex | None = None) -> DataFrame:
    """Events that pass a trigger: ``tickers``, and any of ``entityAny``, and any of ``keywordAny``; missing parts pass all."""
    if match.get("tickers"):
        events = events.where(F.col("ticker").isin(list(match["tickers"])))
    for part in ("entityAny", "keywordAny"):
        if match.get(part):
            events = events.join(matches(tags, vertices, list(match[part])), "ticker", "left_semi")
    return events
