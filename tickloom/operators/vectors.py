"""Exact vector recall: the rows nearest to a query vector by cosine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where a length differs or a vector is zero."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    return F.when(F.size(a) == F.size(b), F.try_divide(_dot(a, b), F.sqrt(_dot(a, a) * _dot(b, b))))


def recall(vectors: DataFrame, query: Sequence[float], k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, score) of the ``k`` nearest rows, the smaller id first on a tie; each task keeps only its own best ``k``."""
    score = cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(vec_id, score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), vec_id).limit(k)


#: Queries and vectors that meet in one task, queries that are scored at once, and pairs whose scores are then made exactly at once.
QUERIES, VECTORS, AT_ONCE, PAIRS = 8192, 4096, 256, 100_000
#: By how much a score from a product of matrices may be off; what is so near the k-th best is scored again.
SLACK = 1e-9


def _rows(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and values of the vectors of each length; those that are null, empty or hold null are left out."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    values, null = flat.to_numpy(zero_copy_only=False), pc.is_null(flat).to_numpy(zero_copy_only=False)
    begins, out = np.cumsum(sizes) - sizes, {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        cells = begins[at][:, None] + np.arange(size)
        good = ~null[cells].any(axis=1)
        out[size] = at[good], values[cells[good]]
    return out


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up from the first component on as cosine() does, so that equal vectors have equal scores."""
    out = np.zeros(len(a))
    for n in range(a.shape[1]):
        out += a[:, n] * b[:, n]
    return out


def _nearest(q: np.ndarray, v: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the best ``k`` rows of ``v`` for each of ``q`` and their scores; NaN is the best, as in an ORDER BY."""
    with np.errstate(all="ignore"):
        qq, vv = _dots(q, q), _dots(v, v)
        for first in range(0, len(q), AT_ONCE):
            some = slice(first, first + AT_ONCE)
            norm = np.sqrt(qq[some, None] * vv)
            about = np.where(norm == 0, -np.inf, np.nan_to_num(q[some] @ v.T / norm, nan=np.inf, posinf=np.inf, neginf=-np.inf))
            least = np.partition(about, len(v) - min(k, len(v)), axis=1)[:, len(v) - min(k, len(v))]
            wanted = (about >= least[:, None] - SLACK) & (norm != 0)
            counts = wanted.sum(axis=1)
            part = (np.cumsum(counts) - counts) // PAIRS
            for n in np.unique(part):
                rows = np.flatnonzero(part == n)
                i, j = np.nonzero(wanted[rows])
                i = rows[i]
                score = _dots(q[first + i], v[j]) / norm[i, j]
                by = np.lexsort((order[j], -np.nan_to_num(score, nan=np.inf), i))
                i, j, score = i[by], j[by], score[by]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield first + i[best], j[best], score[best]


def recall_each(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest of every row of ``queries`` (query_id, query), a stated set of queries.

    All pairs are compared: some QUERIES by some VECTORS meet in a task, in products of matrices. What is as near as the k-th best
    there is scored again as cosine() does, so that results and ties are those of single comparisons.
    """
    groups, parts = (max(1, -(-df.count() // n)) for df, n in ((queries, QUERIES), (vectors, VECTORS)))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query IS NOT NULL")
    asked = asked.select("query_id", "query", deal(groups, "query_id").alias("group"), to(parts).alias("part"))
    known = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding IS NOT NULL")
    known = known.select("vec_id", "embedding", deal(parts, "vec_id", "embedding").alias("part")).withColumn("group", to(groups))
    schema = T.StructType([asked.schema["query_id"], known.schema["vec_id"], T.StructField("score", T.DoubleType())])

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        ids, made = v["vec_id"].combine_chunks(), []
        order = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        asked, known = _rows(q["query"]), _rows(v["embedding"])
        for size in asked.keys() & known.keys():
            (at, a), (of, b) = asked[size], known[size]
            if len(at) and len(of):
                made += [(at[i], of[j], score) for i, j, score in _nearest(a, b, order[of], k)]
        i, j, score = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "vec_id": v["vec_id"].take(pa.array(j)), "score": pa.array(score)})

    pairs = asked.groupBy("group", "part").cogroup(known.groupBy("group", "part")).applyInArrow(compare, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")
