"""Dates as they come with documents, brought to ISO text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

#: Pattern, and which of its groups are year, month, day, hour, minute, second. Tried in this order.
_NUMBERS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", (3, 2, 1)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:T|\s+)(\d{1,2}):(\d{1,2}):(\d{1,2})$", (1, 2, 3, 4, 5, 6)),
)


def _month(name: Column) -> Column:
    """The number of a month written in full or as three letters; 0 for anything else."""
    names = F.array(*[F.lit(m.lower()) for m in MONTHS], *[F.lit(m[:3].lower()) for m in MONTHS])
    place = F.array_position(names, F.lower(name))
    return F.when(place > len(MONTHS), place - len(MONTHS)).otherwise(place).cast("int")


def normalize_asof(c: Column) -> Column:
    """The date of ``c`` as yyyy-MM-dd, null if none is found.

    Understands the formats above, and otherwise takes an ISO-looking prefix as it stands. Built from patterns and a
    validating constructor, so it doesn't depend on the session's parser policy.
    """
    s = F.btrim(c.cast("string"), F.lit(" \t\r\n"))

    def parsed(pattern: str, groups: tuple[int, ...]) -> Column:
        part = [F.nullif(F.regexp_extract(s, pattern, g), F.lit("")) for g in groups]
        month = _month(part[1]) if "A-Z" in pattern else part[1].try_cast("int")
        year, day = part[0].try_cast("int"), part[2].try_cast("int")
        time = [p.try_cast("int") for p in part[3:]] or [F.lit(0)] * 3
        return F.date_format(F.try_make_timestamp_ntz(year, month, day, time[0], time[1], time[2].cast("decimal(8,6)")), "yyyy-MM-dd")

    prefix = F.nullif(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return reduce(lambda out, one: F.coalesce(out, one), [*(parsed(*n) for n in _NUMBERS), prefix])


def recency(as_of: Column, today: Column, days: float = 365.0) -> Column:
    """exp(-age / days): 1 for today and later, 0 for a date that isn't yyyy-MM-dd."""
    date = F.when(as_of.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), as_of.try_cast("date"))
    age = F.greatest(F.lit(0), F.date_diff(today.cast("date"), date))  # greatest() skips nulls
    return F.when(date.isNotNull(), F.exp(-age / F.lit(days))).otherwise(F.lit(0.0))
