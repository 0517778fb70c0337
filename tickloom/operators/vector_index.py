"""A stored index for exact vector recall: inverted lists whose members can be ruled out by the triangle inequality.

Vectors are scaled to length 1, so that a higher cosine is a smaller distance. Each goes to the list of its nearest centre
and keeps its distance r from it. A query at distance d from a centre can't be nearer than |d - r| to a member; once k
near vectors are known, lists and blocks whose least such bound is larger are never read. No vector is lost: centres decide
only what can be skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.vectors import PAIRS, _dots
from tickloom.shared import cut

#: Centres at most, and numbers (vectors times their length) of the sample they are fitted on.
CENTRES, SAMPLE = 1024, 4_000_000
#: Vectors of a block of a list, vectors of a bundle of blocks, and queries that meet a bundle in one task.
BLOCK, BUNDLE, QUERIES = 4096, 8192, 8192
#: Queries that are scored at once, pairs of vector and block or centre whose distances are made at once, and routes that are handed on at once.
AT_ONCE, BOUNDS, ROUTES = 512, 500_000, 4096
#: Scores that agree to so many digits are ties; bounds and scores are loosened by more than sums of products can be off.
DIGITS, SLACK, OFF = 12, 1e-7, 1e-9


def unit(vectors: pd.Series, size: int) -> np.ndarray:
    """The vectors as rows of length 1 in double precision; those that are null, zero, of another size or not finite as nan."""
    out = np.full((len(vectors), size), np.nan)
    for n, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[n] = np.array(v, dtype=float)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        scale = np.abs(out).max(axis=1, keepdims=True) if size else np.zeros((len(out), 1))
        out = out / scale
        out = out / np.sqrt((out * out).sum(axis=1, keepdims=True))
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def _fit(rows: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """``n`` centres of ``rows`` on the unit sphere."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)] if len(rows) else np.zeros((0, rows.shape[1]))
    for _ in range(rounds if len(rows) else 0):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def _distance(dot: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dot, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.combine_chunks().flatten().to_numpy().reshape(len(column), -1)


def _near(q: np.ndarray, v: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of ``q`` and ``v`` that score ``least`` or more, and their scores: the best ``k`` for each of ``q`` and ties at least.

    What a product of matrices shows to be near enough is scored again row by row, so that equal vectors have equal scores.
    """
    about = q @ v.T
    wanted = about >= least[:, None] - OFF
    crowded = np.flatnonzero(wanted.sum(axis=1) > k)
    if len(crowded):
        wanted[crowded] &= about[crowded] >= np.partition(about[crowded], len(v) - k, axis=1)[:, len(v) - k, None] - OFF
    i, j = np.nonzero(wanted)
    score = np.zeros(len(i))
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        score[some] = np.round(_dots(q[i[some]], v[j[some]]), DIGITS)
    good = score >= least[i]
    return i[good], j[good], score[good]


def _first(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """Of (query, id, score) the ``k`` of the highest score for each query, the smaller id first on a tie."""
    i, ids, score = pairs
    by = np.lexsort((ids, -score, i))
    by = by[np.arange(len(i)) - np.searchsorted(i[by], i[by]) < k]
    return i[by], ids[by], score[by]


@dataclass
class VectorIndex:
    """An index at ``path``: its centres, and a table of (list, block, vec_id, vector, r) that grows by extend()."""

    spark: SparkSession
    path: str
    centres: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, path: str, vec_id: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
        """Fits centres on a bounded sample, the first by a hash of the id, and adds all ``vectors``.

        Their length is that of most of the sample; vectors of another one, null, zero or not finite are in no list, as they have no cosine.
        """
        spark = vectors.sparkSession
        sizes = vectors.where(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        size, n = (sizes["size"], sizes["count"]) if sizes else (0, 0)
        most = max(1, min(SAMPLE // max(size, 1), 50 * CENTRES))
        sample = vectors.where(F.size(embedding) == size).orderBy(F.xxhash64(vec_id), vec_id).limit(most).select(embedding).toPandas()[embedding]
        rows = unit(sample, size)
        rows = rows[~np.isnan(rows).any(axis=1)]
        index = cls(spark, path, _fit(rows, min(CENTRES, len(rows), max(1, int(n**0.5)))))
        meta = spark.createDataFrame([(json.dumps(index.centres.tolist()),)], "centres string")
        meta.write.parquet(f"{path}/centres")
        index.extend(vectors, vec_id, embedding)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark, path, np.array(json.loads(spark.read.parquet(f"{path}/centres").first()[0])))

    def extend(self, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> None:
        """Adds further rows to their lists; blocks of each addition are its own, dealt by a hash of the id."""
        centres, size = self.centres, self.centres.shape[1] if self.centres.ndim == 2 else 0
        step = max(1, BOUNDS // max(len(centres), 1))

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for at in range(0, len(whole), step):
                    frame = whole.iloc[at : at + step]
                    rows = unit(frame["vector"], size)
                    good = ~np.isnan(rows).any(axis=1)
                    dot = rows[good] @ centres.T
                    near = dot.argmax(axis=1)
                    kept = frame[good]
                    yield pd.DataFrame({"vec_id": kept["vec_id"], "vector": pd.Series(list(rows[good]), kept.index, object), "list": near, "r": _distance(dot[np.arange(len(near)), near])})

        rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
        placed = cut(rows.mapInPandas(assign, "vec_id long, vector array<double>, list int, r double")) if len(centres) else rows.limit(0).selectExpr("vec_id", "vector", "0 AS list", "0D AS r")
        blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        # nearer members in earlier blocks, so that a block spans few distances; equal ones may stand either way
        span = placed.groupBy("list").agg(F.min("r").alias("least"), F.max("r").alias("most")).join(blocks, "list")
        share = F.coalesce(F.try_divide(F.col("r") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
        dealt = placed.join(F.broadcast(span), "list").withColumn("part", F.least(F.floor(share * F.col("blocks")), F.col("blocks") - 1))
        crowded = dealt.groupBy("list", "part").agg(F.ceil(F.count("*") / BLOCK).alias("pieces"))
        dealt = dealt.join(crowded, ["list", "part"]).withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
        added = self.spark.read.parquet(f"{self.path}/rows").select("addition").agg(F.max("addition")).first()[0] + 1 if self._exists() else 0
        block = F.concat_ws(":", F.lit(added), "part", "piece")
        dealt.select("list", block.alias("block"), "vec_id", "vector", "r", F.lit(added).alias("addition")).repartition("list", "block").sortWithinPartitions("list", "block").write.mode("append").parquet(f"{self.path}/rows")

    def _exists(self) -> bool:
        try:
            self.spark.read.parquet(f"{self.path}/rows")
        except Exception as e:  # the reader has no narrower class for a missing path
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
        return True

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _blocks(self) -> DataFrame:
        """(list, block, n, near, far): how many members a block has and between which distances from the centre."""
        return self.rows().groupBy("list", "block").agg(F.count("*").alias("n"), F.min("r").alias("near"), F.max("r").alias("far"))

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, vec_id, score): the ``k`` members of the highest cosine for each of ``queries`` (query_id, query), the smaller id first on a tie.

        Each query first reads the blocks nearest to it that hold k members; the distance of the k-th of them then rules out
        blocks. Queries without a cosine find nothing.
        """
        return self._search(queries, k)[0]

    def read_share(self, queries: DataFrame, k: int = 5) -> float:
        """The share of all pairs of query and member that a search compares."""
        routes = self._search(queries, k)[1]
        read = routes.agg(F.sum("pairs").alias("read"), F.count_distinct("query_id").alias("queries")).first()
        every = read["queries"] * self.rows().count()
        return read["read"] / every if every else 0.0

    def _search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """What search() returns, and the routes it took: (query_id, query, bundle, wanted, pairs, least).

        A route sends a query to a bundle, some blocks that stand side by side: once for all blocks ``wanted`` there, which hold
        ``pairs`` members. Scores below ``least`` are of no use to it.
        """
        centres, blocks = self.centres, self._blocks().orderBy("list", "block").toPandas()  # a row for each 4,096 vectors and each list
        size = centres.shape[1] if centres.ndim == 2 else 0
        blocks["bundle"] = (blocks["n"].cumsum() - blocks["n"]) // BUNDLE
        shared = self.spark.sparkContext.broadcast((centres, *(blocks[c].to_numpy() for c in ("list", "n", "near", "far", "bundle"))))
        step = max(1, BOUNDS // max(len(blocks), len(centres), 1))
        schema = "query_id long, query array<double>, bundle long, wanted array<int>, pairs long, least double"

        def bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            centres, of, _, near, far, _ = shared.value
            d = _distance(rows @ centres.T)[:, of]
            return d, np.maximum(np.maximum(d - far, near - d), 0)

        def routed(frame: pd.DataFrame, rows: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> Iterator[pd.DataFrame]:
            _, _, n, _, _, bundle = shared.value
            q, b = np.nonzero(wanted)
            begins = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(bundle[b], prepend=-1))
            ends = np.append(begins[1:], len(q))
            for first in range(0, len(begins), ROUTES):
                of, till = begins[first : first + ROUTES], ends[first : first + ROUTES]
                yield pd.DataFrame({
                    "query_id": frame["query_id"].to_numpy()[q[of]], "query": pd.Series(list(rows[q[of]]), dtype=object), "bundle": bundle[b[of]],
                    "wanted": pd.Series([b[x:y].astype(np.int32) for x, y in zip(of, till, strict=True)], dtype=object),
                    "pairs": [int(n[b[x:y]].sum()) for x, y in zip(of, till, strict=True)], "least": least[q[of]],
                })

        def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for at in range(0, len(whole), step):
                    frame = whole.iloc[at : at + step]
                    rows = unit(frame["query"], size)
                    d, least = bounds(rows)
                    order = np.lexsort((d, least))
                    held = shared.value[2][order]
                    wanted = np.zeros(order.shape, bool)
                    np.put_along_axis(wanted, order, np.cumsum(held, axis=1) - held < k, axis=1)
                    yield from routed(frame, rows, wanted & ~np.isnan(rows).any(axis=1)[:, None], np.full(len(frame), -2.0))

        def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in frames:
                for at in range(0, len(whole), step):
                    frame = whole.iloc[at : at + step]
                    rows = np.stack(frame["query"])
                    wanted = bounds(rows)[1] <= frame["reach"].to_numpy()[:, None] + SLACK
                    for i, lists in enumerate(frame["seen"]):
                        for some in lists:
                            wanted[i, np.asarray(some, int)] = False
                    yield from routed(frame, rows, wanted, frame["least"].to_numpy())

        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
        if not len(blocks):
            asked = asked.limit(0)
        once = cut(asked.mapInPandas(first, schema))
        found = self._best(self._compared(once, blocks, k), k)
        # a score stands for all that are rounded to it
        reach = F.sqrt(F.greatest(2 - 2 * (F.col("worst") - 10.0**-DIGITS), F.lit(0.0)))
        known = found.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
        known = known.select("query_id", F.when(F.col("n") >= k, reach).otherwise(4.0).alias("reach"), F.when(F.col("n") >= k, F.col("worst")).otherwise(-2.0).alias("least"))
        seen = once.groupBy("query_id").agg(F.first("query").alias("query"), F.collect_list("wanted").alias("seen"))
        twice = cut(seen.join(known, "query_id").mapInPandas(rest, schema))
        return self._best(found.unionAll(self._compared(twice, blocks, k)), k), once.unionAll(twice)

    def _compared(self, routes: DataFrame, blocks: pd.DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the best k of each bundle for each query sent to it, in the blocks it wants.

        A bundle meets the queries sent to it QUERIES at a time; only blocks of bundles that some query wants are read.
        """
        names = self.spark.createDataFrame([(i, int(r.list), r.block, int(r.bundle)) for i, r in enumerate(blocks.itertuples())], "at int, list int, block string, bundle long")
        groups = cut(routes.groupBy("bundle").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")))
        left = routes.join(F.broadcast(groups), "bundle").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
        right = self.rows().join(F.broadcast(names.join(groups, "bundle")), ["list", "block"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))

        def compare(q: pa.Table, v: pa.Table) -> pa.Table:
            if not len(q) or not len(v):
                return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            v = v.sort_by("at")
            ids, (at, begins) = v["vec_id"].to_numpy(), np.unique(v["at"].to_numpy(), return_index=True)
            a, b, ends = _matrix(q["query"]), _matrix(v["vector"]), np.append(begins[1:], len(ids))
            asked, least, made = q["wanted"].combine_chunks(), q["least"].to_numpy(), []
            for first in range(0, len(a), AT_ONCE):
                part, some = asked[first : first + AT_ONCE], []
                of, wanted = first + np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy()), part.flatten().to_numpy()
                for block, begin, end in zip(at, begins, ends, strict=True):
                    i = of[wanted == block]
                    if len(i):
                        x, j, score = _near(a[i], b[begin:end], least[i], k)
                        some.append(_first((i[x], ids[begin + j], score), k))
                made.append(_first(tuple(np.concatenate(x) for x in zip(*some, strict=True)), k))
            i, found, score = (np.concatenate(x) for x in zip(*made, strict=True))
            return pa.table({"query_id": q["query_id"].take(pa.array(i)), "vec_id": found, "score": score})

        left, right = left.select("bundle", "turn", "query_id", "query", "wanted", "least"), right.select("bundle", "turn", "at", "vec_id", "vector")
        return left.groupBy("bundle", "turn").cogroup(right.groupBy("bundle", "turn")).applyInArrow(compare, "query_id long, vec_id long, score double")

    @staticmethod
    def _best(pairs: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return cut(pairs.withColumn("place", place).where(F.col("place") <= k).drop("place"))
