"""Connected components of a graph of links, by alternating large and small stars; only aggregates reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

#: Edges that one task reduces to a forest.
EDGES_A_TASK = 500_000
#: A group of more members is large; facts of so many large groups are small enough to broadcast (under 100 bytes each).
LARGE, BROADCAST_GROUPS = 1024, 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges but the smallest of each component.

    Labels fall to the smaller end of each edge, then are followed to their own label, until nothing changes.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as forests of at most about EDGES_A_TASK edges each."""
    u = v = np.zeros(0, np.int64)
    for batch in batches:
        u, v = (np.concatenate([x, np.asarray(c)]) for x, c in zip((u, v), batch.columns, strict=True))
        if len(u) > 2 * EDGES_A_TASK:
            u, v = forest(u, v)
            if len(u) > EDGES_A_TASK:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                u = v = np.zeros(0, np.int64)
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b), longs: component is the smallest node reachable.

    Partitions of edges are first reduced to forests, twice, the second time dealt to tasks of EDGES_A_TASK edges. Unless
    one such task held all that was left, each node's neighbours then move to the smallest of them (large star: those
    above the node; small star: those below), until no edge moves; the edges then are stars.
    """
    edges = cut(edges.toDF("u", "v").where("u <> v").mapInArrow(_thin, "u long, v long"))
    tasks = max(1, -(-edges.count() // EDGES_A_TASK))
    edges = cut(edges.repartition(tasks).mapInArrow(_thin, "u long, v long"))
    seen = None
    while tasks > 1:
        both = edges.unionAll(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        stars = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(stars.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_group_facts(rows: DataFrame, facts: DataFrame, key: str, members: str) -> DataFrame:
    """``rows`` joined to the row of ``facts`` with their ``key``; ``members`` of facts counts a group's rows.

    A group may hold most rows, so large groups' rows aren't dealt by their key: large groups are few, and their facts go
    to the rows. Only if there are more than BROADCAST_GROUPS of them is everything shuffled, each key being a small share then.
    """
    large = cut(facts.where(F.col(members) > LARGE))
    n = large.count()
    if not 0 < n <= BROADCAST_GROUPS:
        return rows.join(facts, key)
    rest = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(facts.where(F.col(members) <= LARGE), key)
    return rows.join(F.broadcast(large), key).unionByName(rest)
