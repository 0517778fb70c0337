"""Exact quantiles of large groups by refining histograms: only counts leave the tasks, however many values a group has.

Each round cuts the interval in which a wanted value lies into buckets, counts them, and goes on with the bucket that holds
its rank, shrunk to the least and the greatest value in it. The first round's buckets are logarithmic, so that any range of
doubles takes few rounds; ties end as an interval of one value. All groups and quantiles are refined together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.shared import cut

#: Values of a group up to which one task takes them all.
SMALL = 1_000_000
#: Buckets a round, buckets for each doubling in the first, rounds (each leaves a bucket at least; a double has 52 digits).
BUCKETS, PER_DOUBLING, ROUNDS = 1024, 16, 60
#: Rows of a table of hot groups that are broadcast; more are joined.
SIDE = 100_000


def has_large(rows: DataFrame, value: str, by: Sequence[str], small: int = SMALL) -> bool:
    """Whether any group of ``rows`` has more than ``small`` values."""
    if rows.count() <= small:  # so few in all; a count needs no shuffle
        return False
    sizes = rows.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    return (sizes or 0) > small


def exact(value: Column, fraction: float) -> Column:
    """The quantile of a small group, interpolated; null without values."""
    return F.percentile(value, F.lit(fraction))


def quantiles(rows: DataFrame, value: str, fractions: Mapping[str, float], by: Sequence[str] = (), small: int = SMALL) -> DataFrame:
    """One row a group of ``by`` (or one in all) with the exact quantiles of ``value`` (name: fraction), interpolated.

    Nulls don't count, a group without values has nulls. ``rows`` are read once a round, so should be written before.
    """
    by = list(by)
    out = [exact(F.col(value), f).alias(name) for name, f in fractions.items()]
    if not has_large(rows, value, by, small):
        return rows.groupBy(*by).agg(*out)
    v = F.col(value).cast("double")
    keys = [F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]
    facts = rows.groupBy(*by).agg(F.count(value).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    hot = cut(facts.where(F.col("m") > small).select(*keys, "m", "lo", "hi", F.monotonically_increasing_id().alias("__g")))
    same = _all_equal([rows[c].eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)])
    held = rows.where(F.col(value).isNotNull()).join(_side(hot.select("__g", *[f"__by{k}" for k in range(len(by))])), same).select("__g", v.alias("v"))
    found = _selected(held, _targets(hot, fractions), small)
    named = found.groupBy("__g").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
    large = hot.join(named, "__g").select(*[F.col(f"__by{k}").alias(c) for k, c in enumerate(by)], *fractions)
    if not by:
        return large
    rest = rows.join(_side(hot.select(*[f"__by{k}" for k in range(len(by))])), same, "left_anti")
    return rest.groupBy(*by).agg(*out).unionByName(large)


def _all_equal(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SIDE else df


def _targets(hot: DataFrame, fractions: Mapping[str, float]) -> DataFrame:
    """(__g, name, side, weight, rank, lo, hi, m): the two ranks next to each quantile, in the interval of all values."""
    parts = []
    for name, fraction in fractions.items():
        place = F.lit(float(fraction)) * (F.col("m") - 1)
        low, high = F.floor(place), F.ceil(place)
        sides = [(0, low, F.when(low == high, 1.0).otherwise(high - place)), (1, high, F.when(low == high, 0.0).otherwise(place - low))]
        parts += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), weight.cast("double").alias("weight"), rank.cast("long").alias("rank")) for side, rank, weight in sides]
    return hot.select("__g", F.explode(F.array(*parts)).alias("t"), "lo", "hi", "m").select("__g", "t.*", "lo", "hi", "m")


def _bucket(first: bool) -> Column:
    """The bucket of v in [lo, hi]: never less for a greater value, and lo's is not hi's."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if first:
        size = F.least(F.log2(F.abs(v)), F.lit(2000.0)) + 1100
        return F.when(F.isnan(v), 10**6).when(v == 0, 0).otherwise(F.floor(F.signum(v) * size * PER_DOUBLING)).cast("long")
    share = F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2)
    return F.when(v == lo, 0).when(v == hi, BUCKETS - 1).otherwise(F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 2)), F.lit(1))).cast("long")


def _in_intervals(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(__g, v, lo, hi): values in an interval of some target. A group's intervals don't overlap, so each is in one."""
    intervals = targets.select("__g", "lo", "hi").distinct().groupBy("__g").agg(F.collect_list(F.struct("lo", "hi")).alias("all"))
    at = F.get(F.filter("all", lambda i: (F.col("v") >= i["lo"]) & (F.col("v") <= i["hi"])), F.lit(0))
    return rows.join(_side(cut(intervals)), "__g").withColumn("at", at).where("at IS NOT NULL").select("__g", "v", "at.lo", "at.hi")


def _selected(rows: DataFrame, targets: DataFrame, small: int) -> DataFrame:
    """(__g, name, value): both neighbours of each quantile found, and weighed."""
    targets, done = cut(targets), []
    for round_ in range(ROUNDS):
        open_ = targets.where((F.col("lo") < F.col("hi")) & (F.col("m") > small))
        if open_.isEmpty():
            break
        counts = _in_intervals(rows, open_).groupBy("__g", "lo", "hi", _bucket(round_ == 0).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("to_lo"), F.max("v").alias("to_hi"))
        upto = F.sum("n").over(Window.partitionBy("__g", "lo", "hi").orderBy("b"))
        counts = counts.withColumn("upto", upto).withColumnsRenamed({"lo": "of_lo", "hi": "of_hi", "__g": "of"})
        same = (F.col("__g") == F.col("of")) & (F.col("lo") == F.col("of_lo")) & (F.col("hi") == F.col("of_hi")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        next_ = open_.join(counts, same).select("__g", "name", "side", "weight", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("to_lo").alias("lo"), F.col("to_hi").alias("hi"), F.col("n").alias("m"))
        done.append(targets.where((F.col("lo") == F.col("hi")) | (F.col("m") <= small)))
        targets = cut(next_)
    for more in done:
        targets = targets.unionByName(more)
    targets = cut(targets)
    lists = _in_intervals(rows, targets.where("lo < hi")).groupBy("__g", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("values"))
    single = targets.where("lo = hi").withColumn("value", F.col("lo"))
    several = targets.where("lo < hi").join(lists, ["__g", "lo", "hi"]).withColumn("value", F.get("values", F.col("rank").cast("int"))).drop("values")
    both = single.unionByName(several)
    return both.groupBy("__g", "name").agg(F.sum(F.when(F.col("weight") > 0, F.col("weight") * F.col("value"))).alias("value"))
