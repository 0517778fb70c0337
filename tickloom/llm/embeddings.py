"""Embedding near-duplicates by product quantisation.

Unit vectors are dealt to coarse inverted lists; what is left of a vector after its list's centre is coded by the nearest
centroid of each subspace. A query reads the lists that its near vectors can lie in, adds up table look-ups for the
asymmetric distance to every code of a list, and keeps what can be within the threshold given the code's own error. Kept
pairs are compared by exact cosine. Groups found this way are then compared in full, in blocks, which counts all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, small_batches, written
from tickloom.llm.components import components, forest, with_group_facts

THRESHOLD = 0.9
#: Codes of a subspace, subspaces, vectors of a list on average, and the most lists.
CODES, SUBSPACES, LIST, LISTS = 256, 8, 256, 4096
#: The fitted sample: so many vectors for each list, and so many floats in all, at most.
PER_LIST, SAMPLE_FLOATS = 64, 8_000_000
#: A list is read if its border is nearer than so many deviations of a near vector's step towards it, the spread of steps
#: over directions being that of the fitted sample about its centres. Either of a pair may
#: find the other, and the borders of both add up to the step: a pair is missed only by a step of twice as many.
REACH = 2.0
#: Rows of one side of a block.
BLOCK = 2048


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows of a sorted sample: nothing is random."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(count)
        centres[some] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(count[some])[:-1]])) / count[some, None]
    return centres


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray, rows: int = 4096) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + rows], centres).argmin(1) for i in range(0, len(x), rows)] or [np.zeros(0, np.int64)])


def _spread(left: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The share of a step that goes from one centre towards another, as a standard deviation.

    Steps are spread over directions as ``left`` is; in no direction less than evenly over its effective dimension.
    """
    shape = left.T @ left / max(float((left**2).sum()), 1e-300)  # trace 1
    least = max(float((shape**2).sum()), 1 / left.shape[1])  # 1 / effective dimension
    across = centres @ shape @ centres.T
    own = across.diagonal()
    towards = (own[:, None] + own - 2 * across) / np.maximum(_squares(centres, centres), 1e-12)
    return np.sqrt(np.clip(towards, least, 1.0))


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]
    columns: list[np.ndarray]
    spread: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Quantiser:
        sample = sample[np.lexsort(sample.T[::-1])]
        centres = _means(sample, lists)
        left = sample - centres[_nearest(sample, centres)]
        columns = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        return cls(centres, [_means(left[:, c], CODES) for c in columns], columns, _spread(left, centres))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the distance between each vector and what its codes say."""
        own = _nearest(x, self.centres)
        left = x - self.centres[own]
        codes = np.column_stack([_nearest(left[:, c], b) for c, b in zip(self.columns, self.books, strict=True)]).astype(np.uint8)
        said = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)
        return own, codes, np.sqrt(((left - said) ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of all lists to read for each vector.

        A vector within ``radius`` lies in another list only beyond the plane half way between the centres. A step of that
        length goes radius * ``spread`` towards the plane, as a standard deviation: 1 / sqrt(dimension) of vectors that fill
        their space evenly, more of correlated ones. Every vector asks, so it is enough to reach half of the step: of two
        vectors on either side one is that near the plane.
        """
        rows, lists = [], []
        apart = np.sqrt(_squares(self.centres, self.centres))
        for i in range(0, len(x), 1024):
            d = _squares(x[i : i + 1024], self.centres)
            own = d.argmin(1)
            border = (d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * apart[own], 1e-12)
            r, c = np.nonzero(border <= REACH * radius * self.spread[own])
            rows.append(r + i)
            lists.append(c)
        return np.concatenate(rows), np.concatenate(lists)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of vectors (rows) to codes (columns) of list ``at``, by table look-up."""
        left = x - self.centres[at]
        out = np.zeros((len(x), len(codes)))
        for k, (c, b) in enumerate(zip(self.columns, self.books, strict=True)):
            out += _squares(left[:, c], b)[:, codes[:, k]]
        return np.sqrt(out)


def _unit(vectors) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), np.float64)
    x = x.reshape(len(vectors), -1) if len(vectors) else x.reshape(0, 1)
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, array<double>) to (node, bytes)."""
    for batch in batches:
        blobs = [np.asarray(v.values, np.float64).tobytes() for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "vector"])


def _index(shared, radius: float):
    """Rows of the index (asks false) and of the queries, one for each list that is read (asks true)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1).to_pylist())
            own, codes, error = q.encode(x)
            row, at = q.probes(x, radius)
            names = ["node", "vector", "list", "asks", "codes", "error"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(np.zeros(len(x), bool)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names)
            for i in range(0, len(row), 8192):
                part = batch.take(pa.array(row[i : i + 8192]))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at[i : i + 8192]), pa.array(np.ones(n, bool)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64())], names)

    return deal


def _search(shared, threshold: float, radius: float):
    """Spanning edges of the near pairs of a cell: queries against one block of one list."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        kept, asks = rows[~rows.asks], rows[rows.asks]
        a, b = [], []
        if len(kept) and len(asks):
            q, x, y = shared.value, _unit(list(asks.vector)), _unit(list(kept.vector))
            codes = np.frombuffer(b"".join(kept.codes), np.uint8).reshape(len(kept), -1)
            reach = radius + kept.error.to_numpy() + 1e-9
            for i in range(0, len(x), 512):
                r, c = np.nonzero(q.distances(x[i : i + 512], int(kept.list.iat[0]), codes) <= reach)
                near = np.einsum("ij,ij->i", x[i + r], y[c]) >= threshold
                u, v = asks.node.to_numpy()[i + r[near]], kept.node.to_numpy()[c[near]]
                u, v = forest(u[u != v], v[u != v])
                a.append(u)
                b.append(v)
        return pd.DataFrame({k: np.concatenate(v or [np.zeros(0, np.int64)]) for k, v in (("a", a), ("b", b))})

    return search


def _count(threshold: float):
    """Exact links between two blocks of a group: (node, other, links), spanning edges with links 0, sums with other = node."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, n = [], [], []
        for _, group in rows.sort_values(["component", "node"]).groupby("component"):
            same = group.one.iat[0] == group.two.iat[0]
            left = group[group.block == group.one]
            right = left if same else group[group.block == group.two]
            if not len(left) or not len(right):
                continue
            near = _unit(list(left.vector)) @ _unit(list(right.vector)).T >= threshold
            if same:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            node, other = left.node.to_numpy(), right.node.to_numpy()
            u, v = forest(node[i], other[j])
            a += [u, node] + ([] if same else [other])
            b += [v, node] + ([] if same else [other])
            n += [np.zeros(len(u), np.int64), near @ right.copies.to_numpy()] + ([] if same else [near.T @ left.copies.to_numpy()])
        return pd.DataFrame({k: np.concatenate(v or [np.zeros(0, np.int64)]) for k, v in (("node", a), ("other", b), ("links", n))})

    return count


def _own(blocks: str):
    """The block of a node among so many."""
    return F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks))


def _every(blocks: str):
    return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)


def _linked(classes: DataFrame, n: int, dimension: int, threshold: float, radius: float) -> DataFrame:
    """(a, b): spanning edges of the near pairs among n vectors of one length, found by way of lists."""
    classes = classes.where(F.size("embedding") == dimension)
    blobs = classes.select("node", "embedding").mapInArrow(_blobs, "node long, vector binary")
    lists = int(np.clip(n // LIST, 1, LISTS))
    size = max(1, min(lists * PER_LIST, SAMPLE_FLOATS // dimension))
    sample = blobs.join(F.broadcast(classes.select("node", "embedding").orderBy(F.xxhash64("embedding"), "node").limit(size).select("node")), "node").select("vector").toArrow().column(0).to_pylist()
    if not sample:
        sample = [np.ones(dimension).tobytes()]
    shared = classes.sparkSession.sparkContext.broadcast(Quantiser.fit(_unit(sample), lists))  # LISTS centres at most
    dealt = written(blobs.mapInArrow(_index(shared, radius), "node long, vector binary, list long, asks boolean, codes binary, error double"), "lists")
    # Cells: a list's index in blocks, its queries in blocks.
    number = dealt.groupBy("list").agg(*[F.greatest(F.ceil(F.count(F.when(c, 1)) / BLOCK), F.lit(1)).cast("long").alias(k) for k, c in (("kept_blocks", ~F.col("asks")), ("ask_blocks", F.col("asks")))])
    cells = dealt.join(number, "list").withColumn("i", F.explode(F.when(F.col("asks"), _every("kept_blocks")).otherwise(F.array(_own("kept_blocks"))))).withColumn("j", F.explode(F.when(F.col("asks"), F.array(_own("ask_blocks"))).otherwise(_every("ask_blocks")))).drop("kept_blocks", "ask_blocks")
    return cells.groupBy("list", "i", "j").applyInPandas(_search(shared, threshold, radius), "a long, b long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each vector: (vec_id, n_links, component_id, kept).

    n_links counts the other vectors with a cosine of ``threshold`` or more in double precision, component_id is the
    smallest vec_id that links lead to, kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and vectors link within their length only; equal vectors are one class
    and link with each other. The quantiser of a length is fitted on a bounded sample (PER_LIST, SAMPLE_FLOATS); all vectors are
    indexed and all are queries. Null ids sort first.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    radius = float(np.sqrt(2 - 2 * threshold))
    raw = vectors.select(vectors[vec_id].alias("vec_id"), vectors[embedding].cast("array<double>").alias("embedding")).withColumn("row", F.monotonically_increasing_id())
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # A class of equal vectors is told by 128 bits of its hash, so that no vector is a key of a join or an aggregate.
    keys = [F.when(good, F.xxhash64("embedding", F.lit(k))).alias(f"key{k}") for k in (1, 2)]
    rows = written(raw.select("vec_id", "row", *keys, F.when(good, F.col("embedding")).alias("embedding")), "vectors")
    least = rows.where("key1 IS NOT NULL").groupBy("key1", "key2").agg(F.min(F.struct("vec_id", "row")).alias("least"), F.count("*").alias("copies"))
    least = least.select("key1", "key2", F.col("least.row").alias("node"), F.col("least.vec_id").alias("copy_id"), "copies")
    classes = written(least.join(rows.select(F.col("row").alias("node"), "embedding"), "node"), "classes")
    blobs = classes.select("node", "embedding").mapInArrow(_blobs, "node long, vector binary")
    # Vectors link within a length only: the most common one and all of more than a block have lists, others are one group.
    lengths = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d")
    usual = lengths.first()
    listed = sorted({(r["d"], r["n"]) for r in [*([usual] if usual else []), *lengths.where(F.col("n") > BLOCK).collect()]}) or [(1, 0)]
    edges = reduce(DataFrame.unionAll, [_linked(classes, n, d, threshold, radius) for d, n in listed])
    others = classes.where(~F.size("embedding").isin([d for d, _ in listed])).select("node", (-F.size("embedding")).cast("long").alias("component"))
    groups = cut(components(edges).select("node", "component").unionAll(others))
    blocks = groups.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    member = with_group_facts(groups, blocks, "component", "n").join(classes.select("node", "copies"), "node").join(blobs, "node")
    paired = member.withColumn("block", _own("blocks")).withColumn("other", F.explode(_every("blocks"))).withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    few = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(few))).otherwise(F.xxhash64("component", "one", "two").bitwiseOR(F.lit(1 << 40)))
    exact = written(paired.select(cell.alias("cell"), "component", "node", "copies", "vector", "block", "one", "two").groupBy("cell").applyInPandas(_count(threshold), "node long, other long, links long"), "links")
    sums = exact.where("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    parts = cut(components(exact.where("node <> other").select("node", "other")))
    heads = parts.join(classes.select("node", "copy_id"), "node").groupBy("component").agg(F.count("*").alias("n"), F.min("copy_id").alias("component_id"))
    told = with_group_facts(parts, heads, "component", "n").select("node", "component_id")
    known = classes.select("node", "key1", "key2", "copy_id", "copies").join(sums, "node", "left").join(told, "node", "left")
    known = known.select("key1", "key2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "copy_id").alias("component_id"))
    # classes of many copies are joined apart from the rest, and vectors without a class not at all
    own = rows.select("vec_id", F.struct("key1", "key2").alias("key"))
    linked = with_group_facts(own.where("key.key1 IS NOT NULL"), known.select(F.struct("key1", "key2").alias("key"), "copies", "n_links", "component_id"), "key", "copies").select("vec_id", "n_links", "component_id")
    out = linked.unionAll(own.where("key.key1 IS NULL").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
