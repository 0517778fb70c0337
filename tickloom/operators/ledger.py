"""Spend and token ledgers: by model, by day, by project, against budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.text import last_segment
from tickloom.operators.ranks import running

#: Tokens a day: from the first a warning, from the second no more calls.
SOFT, HARD = 50_000, 100_000
BUDGET_REPLY = "Daily token budget exhausted. Resuming at 00:00 UTC. Queuing scheduled work for the next cycle."


def calls_of(calls: DataFrame, key: str | None) -> DataFrame:
    """The calls of one key; without a key none, as a project without one has no ledger."""
    return calls.where(F.col("alias") == key) if key else calls.limit(0)


def model_key(group: Column, model: Column) -> Column:
    """The model's group, else the last part of its path, else a dash."""
    return F.coalesce(F.nullif(group, F.lit("")), F.nullif(last_segment(model), F.lit("")), F.lit("—"))


def spend_by_model(calls: DataFrame) -> DataFrame:
    """(model, n, spend, tokens) of calls (model_group, model, spend, total_tokens), the dearest first."""
    sums = calls.groupBy(model_key(F.col("model_group"), F.col("model")).alias("model")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("spend"), F.lit(0.0)), 6).alias("spend"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"))
    return sums.orderBy(F.desc("spend"), "model")


def totals(calls: DataFrame) -> DataFrame:
    """One row (n, spend, tokens) over all calls."""
    return calls.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("spend"), F.lit(0.0)), 6).alias("spend"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"))


def recent(calls: DataFrame, time: str = "end_time", ties: tuple[str, ...] = ("request_id",), n: int = 200) -> DataFrame:
    """The last ``n`` calls, those without a time last."""
    return calls.orderBy(F.col(time).desc_nulls_last(), *ties).limit(n)


def daily_tokens(log: DataFrame) -> DataFrame:
    """(date, tokens) of a token log (date, input_tokens, output_tokens); missing numbers count 0."""
    return log.groupBy("date").agg(F.sum(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("long").alias("tokens"))


def spent_on(log: DataFrame, day: str) -> DataFrame:
    """One row (tokens): the tokens of one day, 0 if it has none."""
    return daily_tokens(log.where(F.col("date") == day)).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def budget_state(tokens: Column, soft: int = SOFT, hard: int = HARD) -> Column:
    return F.when(tokens >= hard, "exhausted").when(tokens >= soft, "warn").otherwise("ok")


def budget_gate(log: DataFrame, time: str, ties: tuple[str, ...], soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """``log`` with what each call found: spent_before, refused, reply and soft_warn, in the order of ``time`` within its day.

    Every call counts with its tokens, refused or not, as a log holds only what was let through.
    """
    used = (F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))).cast("long")
    out = running(log.withColumn("__used", used), F.sum, F.col("__used"), [time, *ties], "spent_before", ["date"]).withColumn("spent_before", F.col("spent_before") - F.col("__used"))
    refused = F.col("spent_before") >= hard
    return out.withColumns({"refused": refused, "reply": F.when(refused, F.lit(BUDGET_REPLY)), "soft_warn": F.col("spent_before") + F.col("__used") >= soft}).drop("__used")


def overview(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """(alias, budget, spend, remaining) of every project: without a key the spend is 0 and the budget unknown."""
    k = keys.select(F.col("alias").alias("__alias"), "max_budget", F.col("spend").alias("__spend"))
    joined = projects.join(k, projects["alias"] == k["__alias"], "left")
    spend = F.coalesce("__spend", F.lit(0.0))
    return joined.select("alias", F.col("max_budget").alias("budget"), F.round(spend, 5).alias("spend"), F.round(F.col("max_budget") - spend, 5).alias("remaining"))


def overview_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.round(F.sum(F.coalesce("budget", F.lit(0.0))), 2).alias("total_budget"), F.round(F.sum("spend"), 5).alias("total_spend"))


def with_display(ids: DataFrame, info: DataFrame, hidden: tuple[str, ...] = ("embed",)) -> DataFrame:
    """``ids`` (id) with the display name of ``info`` (id, name), empty where unknown, without the hidden ones."""
    named = info.select(F.col("id").alias("__id"), F.col("name").alias("__name")).dropDuplicates(["__id"])
    kept = ids.where(~F.col("id").isin(*hidden))
    return kept.join(named, kept["id"] == named["__id"], "left").withColumn("name", F.coalesce("__name", F.lit(""))).drop("__id", "__name")
