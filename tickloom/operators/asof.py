"""Backward as-of join: the last row of the right side at or before each row of the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], bucket_days: int | None = 366) -> DataFrame:
    """``left`` with ``payload`` of the last right row of the same ``by`` with right_time <= left_time, else nulls.

    Both sides are put in one frame and a window carries the last right row forward: one shuffle, no range join. A key
    with very many rows is cut into buckets of ``bucket_days`` of time; what a bucket begins with comes from the last
    right row of the buckets before it (a row for each key and bucket). ``bucket_days=None`` leaves keys whole.
    Right rows with a null time never match, left rows with a null time or key stay with nulls. Of right rows with equal
    time the one with the greatest payload counts.
    """
    by = list(by)
    value = F.struct(*payload)
    bucket = (lambda t: F.floor(F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days)) if bucket_days else (lambda t: F.lit(0).cast("long"))
    events = left.select(*[F.col(b) for b in by], F.col(left_time).alias("__t"), F.lit(1).alias("__is_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__value"), F.struct(*left.columns).alias("__row"))
    bars = right.where(F.col(right_time).isNotNull()).select(*[F.col(b) for b in by], F.col(right_time).alias("__t"), F.lit(0).alias("__is_left"), value.alias("__value"), F.lit(None).cast(events.schema["__row"].dataType).alias("__row"))
    both = events.unionByName(bars).withColumn("__bucket", bucket(F.col("__t")))
    keys = [*by, "__bucket"]
    order = Window.partitionBy(*keys).orderBy("__t", "__is_left", "__value")
    seen = both.withColumn("__last", F.last("__value", ignorenulls=True).over(order))
    if bucket_days:
        seen = seen.withColumn("__ends", F.lead(F.lit(False), 1, True).over(order))  # the last row of its bucket
    out = seen.where("__is_left = 1")
    if bucket_days:
        earlier = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = seen.where("__ends").select(*keys, "__last")
        carried = ends.select(*[F.col(k).alias(f"__c{n}") for n, k in enumerate(keys)], F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
        same = [out[k].eqNullSafe(carried[f"__c{n}"]) for n, k in enumerate(keys)]
        out = out.join(carried, same, "left").withColumn("__last", F.coalesce("__last", "__carried"))
    here = F.col("__t").isNotNull()
    return out.select("__row.*", *[F.when(here, F.col("__last")[p]).alias(p) for p in payload])
