"""Signal proposals: validation, JSON out of an agent's text, the queue."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("id", "direction", "trigger")


def problems(proposal_id: Column, direction: Column, has_trigger: Column, has_match: Column) -> Column:
    """What is wrong with a proposal, as an array of texts in a fixed order."""
    filled = {"id": F.coalesce(proposal_id != "", F.lit(False)), "direction": F.coalesce(direction != "", F.lit(False)), "trigger": F.coalesce(has_trigger, F.lit(False))}
    checks = [F.when(~filled[name], F.lit(f"missing '{name}'")) for name in REQUIRED]
    checks.append(F.when(direction.isNotNull() & ~direction.isin("long", "short"), F.lit("direction must be long|short")))
    checks.append(F.when(~F.coalesce(has_match, F.lit(False)), F.lit("trigger.match required")))
    return F.array_compact(F.array(*checks))


def _first_object(text: str | None) -> str | None:
    """The first JSON object in a text whose braces balance and that parses."""
    if not text:
        return None
    opened: list[int] = []
    ends: dict[int, int] = {}
    for at, c in enumerate(text):
        if c == "{":
            opened.append(at)
        elif c == "}" and opened:
            ends[opened.pop()] = at
    for start in sorted(ends):
        try:
            return json.dumps(json.loads(text[start : ends[start] + 1]), sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first JSON object of each text, with sorted keys; null if there is none. Braces are matched in one pass."""
    return texts.map(_first_object)


def queue(proposals: DataFrame) -> DataFrame:
    return proposals.orderBy(F.col("created_at").desc_nulls_last(), "id")


def trigger_tickers(match_tickers: Column, universe: Column) -> Column:
    """The tickers of the trigger, or the universe if it names none."""
    return F.when(F.size(F.coalesce(match_tickers, F.array().cast("array<string>"))) > 0, match_tickers).otherwise(F.coalesce(universe, F.array().cast("array<string>")))
