"""What a set of evaluated events says: hit rate, mean, median, t-statistic, rank correlation and the equity curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ranks import ordinal_ranks, running_product
from tickloom.operators.selection import SMALL, exact, has_large, quantiles
from tickloom.shared import cut

SIGN = {"long": 1.0, "short": -1.0}


def directional(direction: str) -> Column:
    """The forward return as seen by the position; an unknown direction counts as long."""
    return F.lit(SIGN.get(direction, 1.0)) * F.col("fwd")


def skipped(rows: DataFrame) -> DataFrame:
    """Events without an outcome."""
    return rows.where("fwd IS NULL").select("ticker", "as_of")


def event_stats(rows: DataFrame, direction: str = "long", by: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """n, hit_rate, avg_fwd, median_fwd and t_stat of rows (fwd), over all or by group; rows without outcome don't count.

    Without any outcome n is 0 and the rest null. A return of 0 is no hit. t_stat is null unless the deviation is above 0.
    The median is exact: one aggregate where no group has more than ``small`` outcomes, else selected by counts.
    """
    by = by or []
    rows = cut(rows.select(*by, "fwd"))
    r = directional(direction)
    sd, n = F.stddev_samp(r), F.count(r)
    stats = {
        "n": n,
        "hit_rate": F.round(F.avg((r > 0).cast("double")), 4),
        "avg_fwd": F.round(F.avg(r), 6),
        "median_fwd": F.round(exact(r, 0.5), 6),
        "t_stat": F.round(F.when(sd > 0, F.try_divide(F.avg(r), sd / F.sqrt(n.cast("double")))), 3),
    }
    if not has_large(rows, "fwd", by, small):
        return rows.groupBy(*by).agg(*[c.alias(name) for name, c in stats.items()])
    rest = rows.groupBy(*by).agg(*[c.alias(name) for name, c in stats.items() if name != "median_fwd"])
    medians = quantiles(rows.select(*by, r.alias("r")), "r", {"median_fwd": 0.5}, by, small).withColumn("median_fwd", F.round("median_fwd", 6))
    if not by:
        return rest.crossJoin(medians).select(*stats)  # one row each
    names = medians.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], "median_fwd")
    same = [rest[c].eqNullSafe(names[f"__by{k}"]) for k, c in enumerate(by)]
    return rest.join(names, same).select(*by, *stats)


def information_coefficient(rows: DataFrame, ties: tuple[str, ...] = ("as_of", "ticker")) -> DataFrame:
    """One row (n_pairs, ic): correlation of the ordinal ranks of score and raw forward return; null below 3 pairs.

    Equal values are ranked in the order of ``ties``. The direction plays no part.
    """
    pairs = rows.where("score IS NOT NULL AND fwd IS NOT NULL").select("score", "fwd", *ties)
    ranked = ordinal_ranks(pairs, {"s": "score", "f": "fwd"}, list(ties))
    x, y = F.col("s").cast("double"), F.col("f").cast("double")
    # sums instead of corr(), which fails on a constant column
    sums = ranked.agg(F.count("*").alias("n_pairs"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    return sums.select("n_pairs", F.when(F.col("n_pairs") >= 3, F.round(F.try_divide("c", F.sqrt(F.col("vx") * F.col("vy"))), 4)).alias("ic"))


def equity_curve(rows: DataFrame, direction: str = "long", ties: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Rows with an outcome and ``equity``, the running product of 1 + directional return in the order of as_of."""
    held = rows.where("fwd IS NOT NULL").withColumn("__growth", 1 + directional(direction))
    return running_product(held, "__growth", "as_of", list(ties), "equity").drop("__growth")


def stats_record(rows: DataFrame, direction: str = "long", curve_rows: int | None = None) -> DataFrame:
    """One row with all statistics; with ``curve_rows`` also the whole curve as an array, if it has no more rows than that."""
    rows = cut(rows)
    scored = information_coefficient(rows) if "score" in rows.columns else None
    out = event_stats(rows, direction)
    out = out.crossJoin(scored.select("ic")) if scored is not None else out.withColumn("ic", F.lit(None).cast("double"))  # one row each
    if curve_rows is None:
        return out
    if (n := rows.where("fwd IS NOT NULL").count()) > curve_rows:
        raise ValueError(f"a curve of {n} rows is too long for one row; take equity_curve()")
    curve = equity_curve(rows, direction).agg(F.transform(F.array_sort(F.collect_list(F.struct("as_of", "ticker", F.round("equity", 6).alias("equity")))), lambda e: e["equity"]).alias("equity_curve"))
    return out.crossJoin(curve)
