"""Orders over a whole table without one task that holds it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tickloom.shared import cut


#: Rows that one task orders; larger tables are dealt to ranges.
SMALL = 200_000


def running(df: DataFrame, total: Callable[[Column], Column], value: Column, order: Sequence[str], into: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``total`` (a sum or product) of ``value`` over all rows of the same ``by`` up to each in ``order``.

    Rows are dealt to ranges of (by, order), so neither a large group nor many equal values make a large task; a range's
    own total runs within it, what comes before is a total over one row for each group and range. The ranges are sampled,
    and so are written before they are read twice (``ranges``: how many, by default the session's partitions). Rows that are equal in ``order`` may stand either way.
    A table of at most SMALL rows, counted before, is ordered where it is, unless ``ranges`` are given.
    """
    by, order = list(by), list(order)
    if ranges is None and df.count() <= SMALL:
        return df.withColumn(into, total(value).over(_upto(by, order)))
    keys = [*([ranges] if ranges else []), *by, *order]
    placed = cut(df.withColumn("__value", value).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    wholes = placed.groupBy(*by, "__part").agg(total(F.col("__value")).alias("__whole"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = wholes.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__part").alias("__of"), total(F.col("__whole")).over(earlier).alias("__before"))
    own = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("__own", total(F.col("__value")).over(own))
    same = [inner["__part"] == before["__of"], *(inner[c].eqNullSafe(before[f"__by{k}"]) for k, c in enumerate(by))]
    joined = inner.join(before, same)
    both = F.when(F.col("__before").isNull(), F.col("__own")).otherwise(_of_two(total, F.col("__before"), F.col("__own")))
    return joined.withColumn(into, both).select(*[c for c in df.columns if c != into], into)


def _upto(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _of_two(total: Callable[[Column], Column], a: Column, b: Column) -> Column:
    return a * b if total is F.product else a + b


def ordinal_ranks(df: DataFrame, columns: Mapping[str, str], ties: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with the place of each row, from 0, in the order of each of ``columns`` (new column: column), then ``ties``."""
    if ranges is None:
        if df.count() <= SMALL:
            return df.withColumns({into: F.row_number().over(_upto([], [column, *ties])).cast("long") - 1 for into, column in columns.items()})
        ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for into, column in columns.items():
        df = running(df, F.sum, F.lit(1).cast("long"), [column, *ties], into, ranges=ranges).withColumn(into, F.col(into) - 1)
    return df


def running_product(df: DataFrame, value: str, order: str, ties: Sequence[str], into: str) -> DataFrame:
    """``df`` with the product of ``value`` over all rows up to each in the order of ``order``, then ``ties``; no nulls in ``value``."""
    return running(df, F.product, F.col(value), [order, *ties], into)
