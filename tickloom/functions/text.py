"""Text helpers as Column expressions: slugs, truncation, labels, gates, horizons and log cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def safe_ticker(c: Column) -> Column:
    """A path-safe name: runs of other characters become one underscore; ``ticker`` if nothing is left."""
    return _or(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", "_"), F.lit("_")), "ticker")


def model_slug(c: Column) -> Column:
    return _or(F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), "model")


def pool_name(c: Column) -> Column:
    return F.concat(F.lit("or--"), model_slug(c))


def ontology_slug(c: Column) -> Column:
    return _or(F.regexp_replace(F.btrim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9_]", "_"), "x")


def proposal_slug(c: Column, length: int = 24) -> Column:
    """The slug that begins a proposal's id."""
    return _or(F.substring(F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, length), "signal")


def proposal_id(seed: Column, at: Column) -> Column:
    """``sig_``, the second of ``at``, and the slug of the seed."""
    return F.concat(F.lit("sig_"), F.unix_timestamp(at.cast("timestamp")).cast("string"), F.lit("_"), proposal_slug(seed))


def iso_utc(at: Column) -> Column:
    """A time as ISO text to the second, in the session's zone, which should be UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def merged(defaults: Column, over: Column) -> Column:
    """Both maps as one; where both have a key, ``over`` has the say. A null map counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    over = F.coalesce(over, empty)
    return F.map_concat(F.map_filter(F.coalesce(defaults, empty), lambda k, _: ~F.map_contains_key(over, k)), over)


def nearest_name(c: Column, names: Sequence[str], most: int = 2) -> Column:
    """The one of ``names`` (a config's list) with the fewest edits from the value, whatever the case; null beyond ``most``.

    Of equally near ones the first in the alphabet is taken.
    """
    if not names:
        return F.lit(None).cast("string")
    near = F.array(*[F.struct(F.levenshtein(F.lower(c), F.lit(n.lower())).alias("edits"), F.lit(n).alias("name")) for n in names])
    best = F.array_min(near)
    return F.when(best["edits"] <= most, best["name"])


def file_name(c: Column) -> Column:
    """An uploaded file's name with only letters, digits, dot, dash and underscore; ``file`` where there is none."""
    return F.regexp_replace(_or(c, "file"), r"[^A-Za-z0-9._-]", "_")


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def after_prefix(c: Column, prefix: str) -> Column:
    """What follows ``prefix``; null where the value doesn't start with it."""
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any of ``words`` is part of the lower-cased text; without words, true."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(not words)
    for word in words:
        out = out | low.contains(word.lower())
    return out


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)).cast("long")


def horizon_days(c: Column, default: int = 5) -> Column:
    """``5d`` -> 5; anything but digits before trailing d or D gives the default."""
    digits = F.regexp_extract(F.coalesce(c, F.lit("")), "^([0-9]+)[dD]*$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.lit(default))


def is_drop(c: Column) -> Column:
    """Whether a rewriter's output says to drop the document: DROP alone on its first line, or leading a short output."""
    whole = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\r\n\f\x0b"))
    head = F.upper(F.btrim(F.btrim(F.regexp_extract(whole, r"^([^\r\n]*)", 1)), F.lit(".:!\"' ")))
    return (whole != "") & ((head == "DROP") | (F.upper(whole).startswith("DROP") & (F.length(whole) <= 16)))


def match_label(c: Column, labels: Sequence[str]) -> Column:
    """The first declared label that is part of the output, whatever its case; null if none is."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(None).cast("string")
    for label in reversed([x for x in labels if x]):
        out = F.when(low.contains(label.lower()), F.lit(label)).otherwise(out)
    return out


def label_from_value(value: Column, thresholds: Mapping[str, object]) -> Column:
    """High or low label by the threshold ``high`` on the absolute value (or the value, unless ``by`` is ``abs``)."""
    if thresholds.get("high") is None:
        return F.lit(None).cast("string")
    compared = F.abs(value) if thresholds.get("by", "abs") == "abs" else value
    high = compared >= F.lit(float(thresholds["high"]))
    return F.when(value.isNotNull(), F.when(high, F.lit(str(thresholds.get("highLabel", "high")))).otherwise(F.lit(str(thresholds.get("lowLabel", "low")))))


def message_text(content: Column, text: Column | None = None) -> Column:
    """The text of a message: ``text`` where its content is a string, else the non-null parts of the array of struct<text>, one a line."""
    parts = F.concat_ws("\n", F.filter(F.transform(content, lambda part: part["text"]), lambda text: text.isNotNull()))
    return parts if text is None else F.coalesce(text, parts)


def resolve_role(role: Column, roles: Column | None, defaults: Mapping[str, str]) -> Column:
    """A role's model: the project's map, then the defaults, then the role itself; empty names count as missing."""
    own = F.nullif(F.try_element_at(roles, role), F.lit("")) if roles is not None else F.lit(None).cast("string")
    entries = [F.lit(x) for pair in defaults.items() for x in pair]
    return F.coalesce(own, F.try_element_at(F.create_map(*entries), role) if entries else F.lit(None).cast("string"), role)


def without_ansi(c: Column) -> Column:
    """Without the escape sequences that colour a terminal's text."""
    return F.regexp_replace(c, r"\x1b\[[0-9;]*m", "")


def log_tail(c: Column, length: int = 6000) -> Column:
    """The end of a log without colours, blank lines and lines that begin with a timestamp."""
    lines = F.split(without_ansi(F.coalesce(c, F.lit(""))), "\n")
    return F.right(F.concat_ws("\n", F.filter(lines, lambda line: ~line.rlike(r"^\s*(\d{4}-\d\d-\d\dT|$)"))), F.lit(length))
