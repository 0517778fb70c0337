"""Rules compiled to CASE expressions: which model a document goes to, which tier a request."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that ask for thorough thinking, and words of routine requests.
REASONING = r"\b(why|anomal\w*|investigat\w*|explain\s+why|root\s+cause|incident\w*|correlat\w*|novelty|pass\s*2|gap\s+analy\w*|debug\s+this|interpret\w*|deep\s+dive|reason\s+about)\b"
ROUTINE = r"\b(acknowledge|confirm|yes/no|did this succeed|is this done|return the result|extract the field|format as|next step|which schedule|when did|is .* present)\b"
HIGH, MID, LOW = "high", "mid", "low"
MAX_OUTPUT_TOKENS = 2000
MAX_CHARS = 40_000


def _list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _text_in(column: Column, allowed: Sequence) -> Column:
    texts = [str(a) for a in allowed if a is not None]
    hit = F.coalesce(column.isin(texts), F.lit(False)) if texts else F.lit(False)
    return hit | column.isNull() if any(a is None for a in allowed) else hit


def rule(condition: Mapping, doc_type: Column, relevance: Column, tags: Column, text: Column, meta: Column) -> Column:
    """A rule's condition as a boolean Column; never null.

    All keys must hold: docType, tag, relevance, signal, pattern, minLength, maxLength. An empty condition never holds;
    unknown keys, an empty ``signal`` and a blank ``pattern`` always do; a null docType or relevance never matches; a
    pattern that isn't one never matches. Texts are searched whatever their case.
    """
    if not condition:
        return F.lit(False)
    text = F.coalesce(text, F.lit(""))
    parts = []
    if "docType" in condition:
        parts.append(doc_type.isNotNull() & _text_in(doc_type, [x for x in _list(condition["docType"]) if x is not None]))
    if "tag" in condition:
        want = [str(t).lower() for t in _list(condition["tag"])]
        low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t))
        parts.append(F.coalesce(F.arrays_overlap(low, F.array(*[F.lit(w) for w in want])), F.lit(False)) if want else F.lit(False))
    if "relevance" in condition:
        parts.append(relevance.isNotNull() & _text_in(relevance, [x for x in _list(condition["relevance"]) if x is not None]))
    for key, allowed in (condition.get("signal") or {}).items():
        parts.append(_text_in(F.try_element_at(meta, F.lit(key)), _list(allowed)))
    if condition.get("pattern"):
        try:
            re.compile(condition["pattern"])
            parts.append(text.rlike("(?iU)" + condition["pattern"]))
        except re.error:
            parts.append(F.lit(False))
    if "minLength" in condition:
        parts.append(F.length(text) >= int(condition["minLength"]))
    if "maxLength" in condition:
        parts.append(F.length(text) <= int(condition["maxLength"]))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def public(meta: Column) -> Column:
    """The map without the private keys, which begin with an underscore."""
    return F.map_filter(meta, lambda k, v: ~k.startswith("_"))


def pick_model(config: Mapping, doc_type: Column, relevance: Column, tags: Column, text: Column, meta: Column) -> Column:
    """The role of the first rule that holds, else the default; a rule without a model stands for the default."""
    default = config.get("defaultModel") or "extractor"
    routing = config.get("routing") or {}
    if not routing.get("enabled", True):
        return F.lit(default)
    out = F.lit(default)
    for r in reversed(routing.get("rules") or []):
        out = F.when(rule(r.get("if") or {}, doc_type, relevance, tags, text, public(meta)), F.lit(r.get("model") or default)).otherwise(out)
    return out


def route(docs: DataFrame, config: Mapping, override: Column | None = None, into: str = "model") -> DataFrame:
    """``docs`` (text, tags, meta) with the model; a named ``override`` other than ``auto`` wins over the rules."""
    picked = pick_model(config, F.try_element_at("meta", F.lit("docType")), F.try_element_at("meta", F.lit("relevance")), F.col("tags"), F.col("text"), F.col("meta"))
    if override is not None:
        picked = F.when(F.coalesce(~override.isin("", "auto"), F.lit(False)), override).otherwise(picked)
    return docs.withColumn(into, picked)


def fits(text: Column, most: int = MAX_CHARS) -> Column:
    """Whether a text is short enough to be preprocessed in one pass."""
    return F.length(F.coalesce(text, F.lit(""))) <= most


def tier(text: Column, tools: Column, requested: Column | None = None) -> Column:
    """struct(tier, reason) of a request: ``text`` is that of all its messages, ``tools`` whether it brings tools.

    A tier asked for by name is taken as it is.
    """
    text, tools = F.coalesce(text, F.lit("")), F.coalesce(tools, F.lit(False))
    answer = lambda t, why: F.struct(F.lit(t).alias("tier"), F.lit(why).alias("reason"))
    out = (
        F.when(text.rlike("(?iU)" + REASONING), answer(HIGH, "reasoning_pattern"))
        .when(tools & (F.length(text) > 1500), answer(MID, "tools_with_long_context"))
        .when(text.rlike("(?iU)" + ROUTINE), answer(LOW, "routine_pattern"))
        .when((F.length(text) < 800) & ~tools, answer(LOW, "short_request"))
        .otherwise(answer(MID, "default"))
    )
    if requested is None:
        return out
    named = F.struct(requested.alias("tier"), F.concat(F.lit("explicit:"), requested).alias("reason"))
    return F.when(F.coalesce(requested.isin(HIGH, MID, LOW), F.lit(False)), named).otherwise(out)


def output_cap(max_tokens: Column, most: int = MAX_OUTPUT_TOKENS) -> Column:
    """The tokens a reply may have: ``most`` if none, 0 or more were asked for."""
    return F.when(F.coalesce(max_tokens, F.lit(0)) == 0, F.lit(most)).otherwise(F.least(max_tokens, F.lit(most)))
