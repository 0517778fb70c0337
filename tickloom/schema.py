"""The bar table: its columns, and the one place where foreign frames are brought to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQS = ("1d", "1m")

BARS = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(name, T.DoubleType()) for name in ("open", "high", "low", "close", "volume")],
        T.StructField("adjusted", T.BooleanType()),
        T.StructField("freq", T.StringType()),
    ]
)
REQUIRED = ("ticker", "ts", "close", "freq")


def missing(df: DataFrame) -> list[str]:
    """The required columns that ``df`` lacks, sorted."""
    return sorted(set(REQUIRED) - set(df.columns))


def normalise(df: DataFrame) -> DataFrame:
    """``df`` in the columns and types of BARS: values that don't parse are null, ``adjusted`` is false where unknown.

    Raises ValueError for a missing required column while the plan is built, so nothing has been written by then.
    """
    if lacking := missing(df):
        raise ValueError(f"bars need the columns {lacking}")
    columns = []
    for field in BARS:
        value = df[field.name].try_cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        columns.append((F.coalesce(value, F.lit(False)) if field.name == "adjusted" else value).alias(field.name))
    return df.select(columns)


def incomplete(df: DataFrame) -> Column:
    """Whether a row has no value in one of the required columns, or ``df`` lacks it."""
    out = F.lit(bool(missing(df)))
    for name in REQUIRED:
        out = out | df[name].isNull() if name in df.columns else out
    return out


def freq_problem(freq: Column) -> Column:
    """What is wrong with a freq that isn't one of FREQS; null for one that is."""
    known = F.coalesce(freq.isin(*FREQS), F.lit(False))
    return F.when(~known, F.concat(F.lit("invalid freq: "), F.coalesce(freq, F.lit("null")), F.lit(f"; expected one of {', '.join(FREQS)}")))


def check_freq(df: DataFrame) -> DataFrame:
    """``df``, which fails when run if a row's freq isn't one of FREQS."""
    problem = freq_problem(F.col("freq"))
    return df.withColumn("freq", F.when(problem.isNull(), F.col("freq")).otherwise(F.raise_error(problem).cast("string")))
