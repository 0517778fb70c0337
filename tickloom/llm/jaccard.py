"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until their buckets are small.

A document is its set of five-word shingles. Equal sets are one class. Every run walks a tree of chosen paths: at a node
each of the K MinHash coordinates is chosen with probability 1 / (threshold * K), and the sets of the node go on to a
bucket for each value of a chosen coordinate. Small buckets are compared in full; larger ones are compared with their
least member and split again. So many runs are made that a pair at the threshold meets with the target recall. The
groups found are then compared exactly, in blocks, which gives every link inside a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textblocks as tb
from tickloom.llm.common import cut, parts_for, small_batches, small_side, written
from tickloom.llm.components import components, forest, with_group_facts

THRESHOLD, SHINGLE = 0.8, 5
#: MinHash coordinates; the margin below the threshold at which estimates are still candidates (four deviations).
K, MARGIN = 64, 0.2
#: The largest bucket compared in full, how often a larger one is split, and the recall that the runs are to reach.
LEAF, DEPTH, RECALL = 48, 2, 0.9999
#: Documents and shingles of a block of the exact comparison.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000
_COLUMNS = 4096

_seed = np.random.default_rng(20260117)
_MULTIPLY = _seed.integers(1, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seed.integers(0, 2**63, K, np.uint64)


def runs_for(recall: float = RECALL, depth: int = DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``.

    A pair survives a level like a branching process with 1 / threshold chosen coordinates that agree with probability
    ``threshold``; the number of chosen coordinates is nearly Poisson.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and each text's first."""
    starts, ends, first = tb.spans(data, offsets)
    h, begin = tb.grams(tb.span_hashes(data, starts, ends), first, n)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], np.searchsorted(own[new], np.arange(len(offsets)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n, key1, key2, sketch): MinHash values, and a key of the set."""
    for batch in batches:
        for row, end, data, offsets in tb.slices(batch.column(2)):
            h, first = sets(data, offsets)
            some = np.flatnonzero(np.diff(first))
            count = end - row
            sketch, keys = np.zeros((count, K), np.uint32), np.zeros((2, count), np.uint64)
            if len(some):
                for k in range(K):
                    sketch[some, k] = np.minimum.reduceat(((h * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)).astype(np.uint32), first[some])
                keys[0, some], keys[1, some] = np.add.reduceat(h, first[some]), np.add.reduceat(tb.mixed(h), first[some])
            binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * K), count, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
            rest = [pa.array(x) for x in (np.diff(first), keys[0].view(np.int64), keys[1].view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, count), batch.column(1).slice(row, count), *rest, binary], ["doc_id", "text_hash", "n", "key1", "key2", "sketch"])


def _sketch(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _choose(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, next path) for each chosen coordinate of each row: chosen by the path alone, the next path adds the value."""
    rows, paths = [], []
    limit = np.uint64(min(1.0, 1 / (threshold * K)) * 2**63) * np.uint64(2)
    for k in range(K):
        coin = tb.mixed(path + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = np.flatnonzero(coin < limit)
        rows.append(at)
        paths.append(tb.mixed(coin[at] ^ (sketch[at, k].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))))
    return np.concatenate(rows), np.concatenate(paths)


def _next_level(runs: int, threshold: float):
    """(path, node) of the next level; rows of (node, path, sketch), where runs > 0 stands for that many roots."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sketch = np.asarray(batch.column(0)), _sketch(batch.column(2))
            paths = np.asarray(batch.column(1)).view(np.uint64)
            for run in range(max(runs, 1)):
                row, path = _choose(np.full(len(node), tb.mixed(np.array([run], np.uint64))[0]) if runs else paths, sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[row])], ["path", "node"])

    return step


def _close(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return (a == b).mean(-1) >= least


def _leaves(least: float):
    """Edges of a spanning forest of each small bucket: (nodes, sketches) lists."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            sketch = _sketch(batch.column(1).flatten())
            nodes, first = np.asarray(batch.column(0).flatten()), np.concatenate([[0], np.cumsum(np.asarray(batch.column(0).value_lengths()))])
            for s, e in zip(first[:-1], first[1:], strict=True):
                i, j = np.triu_indices(e - s, 1)
                near = _close(sketch[s + i], sketch[s + j], least)
                if near.any():
                    u, v = forest(nodes[s + i[near]], nodes[s + j[near]])
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.int64)])) for x in (a, b)], ["a", "b"])

    return compare


def _pivots(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _close(_sketch(batch.column(2)), _sketch(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return compare


def _block_pair(least: float):
    """Spanning edges of the close pairs between two blocks of sketches."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.block == rows.one], rows[rows.block == rows.two]
        b, nodes = np.frombuffer(b"".join(right.sketch), np.uint32).reshape(-1, K), right.node.to_numpy()
        u, v = [], []
        for node, sketch in zip(left.node, left.sketch, strict=True):
            near = nodes[_close(np.frombuffer(sketch, np.uint32), b, least)]
            u.append(np.full(len(near), node))
            v.append(near)
        found = forest(np.concatenate(u or [np.zeros(0, np.int64)]), np.concatenate(v or [np.zeros(0, np.int64)]))
        return pd.DataFrame({"a": found[0], "b": found[1]})

    return compare


def in_block_pairs(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """``rows`` once for each pair of blocks of its ``key`` that its own block is in: adds block, one <= two."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col(blocks)))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return other.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other")


def candidate_groups(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of the nodes that share a group of near sets. classes: (node, sketch)."""
    spark = classes.sparkSession
    least, runs = threshold - MARGIN, runs_for(threshold=threshold)
    rows = classes.select("node", F.lit(0).cast("long").alias("path"), "sketch").mapInArrow(_next_level(runs, threshold), "path long, node long")
    edges, labels = None, None
    for depth in range(1, DEPTH + 1):
        rows = written(rows, "paths")
        marked = rows.withColumn("label", F.col("node")) if labels is None else rows.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = marked.groupBy("path").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("n > 1 AND l1 <> l2").drop("l1", "l2")
        held = written(with_group_facts(rows, sizes, "path", "n").join(classes.select("node", "sketch"), "node"), "buckets")
        lists = held.where(F.col("n") <= LEAF).groupBy("path").agg(F.collect_list("node").alias("nodes"), F.collect_list("sketch").alias("sketches")).select("nodes", "sketches")
        large = held.where(F.col("n") > LEAF)
        heads = large.where("node = pivot").select("path", F.col("sketch").alias("head"))
        stars = large.join(heads, "path").where("node <> pivot").select("node", "pivot", "sketch", "head")
        found = lists.mapInArrow(_leaves(least), "a long, b long").unionAll(stars.mapInArrow(_pivots(least), "a long, b long"))
        edges = written((found if edges is None else edges.unionAll(found)).distinct(), "edges")
        rows = large.select("node", "path", "sketch")
        if depth < DEPTH:
            labels = cut(components(edges))
            rows = rows.mapInArrow(_next_level(0, threshold), "path long, node long").distinct()
    # What is still large and of several groups after the last split is compared in full, block by block.
    rows = rows.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("path").agg(F.count("*").alias("n"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("path", F.ceil(F.col("n") / BLOCK_DOCS).cast("long").alias("blocks"))
    cells = in_block_pairs(rows.join(mixed, "path").select("path", "node", "sketch", "blocks"), "path", "blocks").repartition(parts_for(spark, 0, 1), "path", "one", "two")
    more = cells.groupBy("path", "one", "two").applyInPandas(_block_pair(least), "a long, b long")
    return cut(components(edges.unionAll(more)))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column of (node, text, ...) becomes the bytes of the text's shingle set."""
    for batch in batches:
        for row, end, data, offsets in tb.slices(batch.column(1)):
            h, first = sets(data, offsets)
            held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - row, [None, pa.py_buffer((first * 8).astype(np.int64).tobytes()), pa.py_buffer(h.tobytes())]).cast(pa.binary())
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([part.column(0), held, *part.columns[2:]], batch.schema.names)


def shared(values: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set of ``left`` has in common with each of ``right`` (numbers of sets in ``values``)."""
    every = np.concatenate(values)
    own = np.repeat(np.arange(len(values)), [len(v) for v in values])
    order = np.argsort(every, kind="stable")
    every, own = every[order], own[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    twice = np.bincount(number)[number] > 1
    own, number = own[twice], np.unique(number[twice], return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(number.max()) + 1 if len(number) else 0, _COLUMNS):
        s, e = np.searchsorted(number, [start, start + _COLUMNS])
        has = np.zeros((len(values), min(_COLUMNS, int(number[e - 1]) - start + 1)), np.float32)
        has[own[s:e], number[s:e] - start] = 1
        out += has[left] @ has[right].T
    return out


def _compare(threshold: float):
    """Exact links of a cell: (node, other, links): spanning edges have links 0, sums of links have other = node."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, count = [], [], []
        for _, group in rows.sort_values(["component", "node"]).groupby("component"):
            node, copies = group.node.to_numpy(), group.copies.to_numpy()
            values = [np.frombuffer(v, np.uint64) for v in group.text]
            size = np.array([len(v) for v in values])
            same = group.one.iat[0] == group.two.iat[0]
            left = np.flatnonzero(group.block == group.one)
            right = left if same else np.flatnonzero(group.block == group.two)
            if not len(left) or not len(right):
                continue
            common = shared(values, left, right)
            near = common >= threshold * (size[left][:, None] + size[right][None] - common) - 1e-6
            if same:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            u, v = forest(node[left[i]], node[right[j]])
            a += [u, node[left]] + ([] if same else [node[right]])
            b += [v, node[left]] + ([] if same else [node[right]])
            count += [np.zeros(len(u), np.int64), near @ copies[right]] + ([] if same else [near.T @ copies[left]])
        return pd.DataFrame({k: np.concatenate(x or [np.zeros(0, np.int64)]) for k, x in (("node", a), ("other", b), ("links", count))})

    return links


def links(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (doc_id, text_hash, class_id, copy_id, n_links, kept).

    Words are runs of anything but ASCII white space; a text of fewer than five words has one shingle, all its words.
    copy_id is the smallest doc_id with the same set of shingles, n_links the number of other documents with a
    similarity of ``threshold`` or more (copies among them), class_id the smallest doc_id that links lead to, kept whether
    the row stands for its class. Texts without words link with nothing and are kept; null ids sort first and repeated rows are
    documents of their own, of which one is kept. An empty table gives no rows; further columns play no part.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text].cast("binary")).alias("text_hash"), docs[text].alias("text"))
    kind = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("text_hash", "n", "key1", "key2")), T.StructField("sketch", T.BinaryType())])
    sketched = written(rows.mapInArrow(_sketches, kind).withColumn("row", F.monotonically_increasing_id()), "sketches")
    some = sketched.where("n > 0")
    classes = some.groupBy("key1", "key2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row", "text_hash")).alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("key1", "key2", F.col("least.row").alias("node"), F.col("least.doc_id").alias("copy_id"), F.col("least.text_hash").alias("text_hash"), "copies", "n", "sketch"), "classes")
    groups = candidate_groups(classes.select("node", "sketch"), threshold)
    sizes = groups.join(classes, "node").groupBy("component").agg(F.count("*").alias("members"), F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"), F.sum("n").alias("shingles"))
    chosen = cut(with_group_facts(groups, sizes, "component", "members").drop("members", "shingles").join(classes.select("node", "copy_id", "text_hash", "copies"), "node"))
    # texts stay where they are unless very many documents are in groups
    texts = rows.join(small_side(chosen).withColumnRenamed("text_hash", "hash"), rows["doc_id"].eqNullSafe(F.col("copy_id")) & (rows["text_hash"] == F.col("hash"))).dropDuplicates(["node"])
    held = texts.select("node", "text", "component", "copies", "blocks")
    held = held.mapInArrow(_shingles, T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("component", "copies", "blocks"))]))
    # Groups of one block share cells, so that small groups don't each cost a call.
    total = sizes.agg(F.sum("shingles")).first()[0] or 0
    cells = parts_for(spark, total, BLOCK_SHINGLES)
    paired = in_block_pairs(held, "component", "blocks").withColumn("cell", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(cells))).otherwise(F.xxhash64("component", "one", "two")))
    paired = paired.withColumn("cell", F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.col("cell").bitwiseOR(F.lit(1 << 40))))
    exact = written(paired.select("cell", "component", "node", "copies", "text", "block", "one", "two").groupBy("cell").applyInPandas(_compare(threshold), "node long, other long, links long"), "links")
    number = exact.where("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    parts = cut(components(exact.where("node <> other").select("node", "other")))
    least = parts.join(classes.select("node", F.struct("copy_id", "node").alias("one")), "node").groupBy("component").agg(F.count("*").alias("members"), F.min("one").alias("one"))
    member = classes.join(number, "node", "left").join(with_group_facts(parts, least, "component", "members").select("node", F.col("one.copy_id").alias("class_id"), F.col("one.node").alias("head")), "node", "left")
    member = member.select(F.struct("key1", "key2").alias("key"), "copies", "node", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("head").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head", "node").alias("head"))
    out = with_group_facts(some.select("doc_id", "text_hash", "row", F.struct("key1", "key2").alias("key")), member, "key", "copies").select("doc_id", "text_hash", "class_id", "copy_id", "n_links", (F.col("row") == F.col("head")).alias("kept"), "row")
    alone = sketched.where("n = 0").select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "row")
    return out.unionAll(alone).drop("row")


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near-duplicates as in links() (the smallest doc_id), columns as they were.

    Rows of null or empty text all stay, a null doc_id counts as the smallest, of repeated rows one stays, and an empty
    table gives an empty one.
    """
    found = links(docs, threshold, doc_id, text).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.count(F.when(F.col("kept"), 1)).alias("keeps"))
    # Rows that are alike in id and text can only be told apart by leaving out the surplus; all others go or stay whole.
    told = written(found.where("keeps < n").select("doc_id", "text_hash", (F.col("keeps") > 0).alias("some")), "told")
    hashed = docs.select(F.struct(*docs.columns).alias("row"), docs[doc_id].alias("id"), F.xxhash64(docs[text].cast("binary")).alias("hash"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    rest = hashed.join(small_side(told), same, "left_anti")
    some = hashed.join(small_side(told.where("some")), same, "left_semi").dropDuplicates(["id", "hash"])
    return rest.unionByName(some).select("row.*")
