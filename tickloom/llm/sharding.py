"""K-d tree partitioning: shards of near-equal bytes, cut at distributed weighted medians.

Every node of the tree is cut along its widest metadata dimension at the weighted median of bytes, until there are as
many leaves as shards. Medians come from histograms: bytes by node and value range, the range that holds the median
split again until it is one value. Only those histograms (at most ``FAN`` rows for a node) reach the driver. All work is
DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import cut, parts_for

#: Ranges of a histogram for each node and round.
FAN = 2048
#: A cut stays between groups of equal texts if that misses the median by at most this part of a shard.
TOLERANCE = 0.002
#: The metadata dimensions (source and language as crc32 numbers), then what orders documents equal in the dimension of a cut.
DIMENSIONS = ("d_source", "d_bytes", "d_lang", "d_doc")
TIES = ("text_crc32", "doc_id", "row_no")
ROWS_A_SLOT_RANGE = 200_000


def _points(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """A row for each document with its coordinates. Equal texts share the coordinates of the least of them."""
    utf8 = F.coalesce(docs[text].cast("binary"), F.lit(b""))
    number = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))
    rows = cut(docs.select(docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), number(docs[lang]).alias("lang"), number(docs[source]).alias("source")).withColumn("row_no", F.monotonically_increasing_id()))
    own = {"d_source": F.col("source"), "d_lang": F.col("lang"), "d_doc": F.coalesce("doc_id", F.lit(-1))}
    # Only texts that occur again are joined, and from a table of their own: Spark can then split a group that is most of all rows.
    groups = cut(rows.groupBy("text_crc32", "size").agg(F.count("*").alias("n"), *[F.min(c).alias(f"least_{k}") for k, c in own.items()]).where("n > 1").drop("n"))
    joined = rows.join(groups, ["text_crc32", "size"], "left")
    shared = [F.coalesce(f"least_{k}", c).alias(k) for k, c in own.items()]
    return cut(joined.select("doc_id", "size", "text_crc32", "row_no", *shared, F.col("size").alias("d_bytes")).fillna(-1, ["doc_id"]).withColumn("had_id", F.col("doc_id") != -1))


def _below(keys: list[str], at: list[int]) -> Column:
    """(keys) < (at) in lexicographic order."""
    return reduce(lambda rest, kv: (F.col(kv[0]) < F.lit(kv[1])) | ((F.col(kv[0]) == F.lit(kv[1])) & rest), list(zip(keys, at, strict=True))[::-1], F.lit(False))


def _by_node(column: str, values: dict) -> Column:
    return reduce(lambda out, kv: out.when(F.col(column) == kv[0], kv[1]), list(values.items())[1:], F.when(F.col(column) == next(iter(values)), next(iter(values.values()))))


class _Cut:
    """The search for one node's cut: the keys settled so far, and the range of the key under search."""

    def __init__(self, keys: list[str], half: float, slack: float):
        self.keys, self.half, self.slack, self.at, self.before, self.range, self.done = keys, half, slack, [], 0, None, False

    def settle(self, value: int, before: int, inside: int) -> None:
        """``before`` bytes lie below ``value`` and ``inside`` on it: cut there if that is near enough, or look within."""
        last = len(self.at) + 1 == len(self.keys)
        low, high = abs(before - self.half), abs(before + inside - self.half)
        upto = value + 1 if high < low else value
        self.at.append(value)
        self.before = before
        self.range = None
        if last or min(low, high) <= self.slack:
            self.at[-1], self.done = upto, True


def _cuts(points: DataFrame, nodes: dict[int, tuple[int, int]], shard_bytes: float, whole: dict[str, int]) -> dict[int, Column]:
    """For each node (id: (left leaves, all leaves)) the condition under which a document goes left.

    ``whole`` is each dimension's width at the root, by which widths are compared; it is filled in there.
    """
    stats = points.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).where(F.col("node").isin(list(nodes))).collect()
    if not whole:
        whole |= {c: max([1, *(r[f"hi_{c}"] - r[f"lo_{c}"] for r in stats)]) for c in DIMENSIONS}
    cuts = {}
    for r in stats:
        widest = max(DIMENSIONS, key=lambda c: (r[f"hi_{c}"] - r[f"lo_{c}"]) / whole[c])
        left, leaves = nodes[r["node"]]
        cuts[r["node"]] = _Cut([widest, *TIES], r["bytes"] * left / leaves, shard_bytes * TOLERANCE)
    while open_cuts := {n: c for n, c in cuts.items() if not c.done}:
        key = _by_node("node", {n: F.col(c.keys[len(c.at)]) for n, c in open_cuts.items()})
        on = _by_node("node", {n: reduce(lambda a, kv: a & (F.col(kv[0]) == F.lit(kv[1])), zip(c.keys, c.at, strict=False), F.lit(True)) for n, c in open_cuts.items()})
        active = points.where(F.coalesce(on, F.lit(False))).withColumn("key", key)
        if any(c.range is None for c in open_cuts.values()):
            for r in active.groupBy("node").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
                if open_cuts[r["node"]].range is None:
                    open_cuts[r["node"]].range = (r["lo"], r["hi"])
        step = {n: (c.range[1] - c.range[0]) // FAN + 1 for n, c in open_cuts.items()}
        low, width = (_by_node("node", {n: F.lit(v) for n, v in x.items()}) for x in ({n: c.range[0] for n, c in open_cuts.items()}, step))
        high = _by_node("node", {n: F.lit(c.range[1]) for n, c in open_cuts.items()})
        sums: dict[int, list] = {}
        for r in active.where(F.col("key").between(low, high)).groupBy("node", F.floor((F.col("key") - low) / width).alias("bucket")).agg(F.sum("size").alias("bytes")).orderBy("node", "bucket").collect():
            sums.setdefault(r["node"], []).append((r["bucket"], r["bytes"]))
        for n, c in open_cuts.items():
            before = c.before
            for bucket, held in sums[n]:
                if before + held >= c.half or (bucket, held) == sums[n][-1]:
                    break
                before += held
            start = c.range[0] + bucket * step[n]
            if step[n] == 1:
                c.settle(start, before, held)
            elif min(abs(before - c.half), abs(before + held - c.half)) <= c.slack:
                c.at.append(start if abs(before - c.half) <= abs(before + held - c.half) else start + step[n])
                c.done = True
            else:
                c.before, c.range = before, (start, min(start + step[n] - 1, c.range[1]))
    return {n: _below(c.keys[: len(c.at)], c.at) for n, c in cuts.items()}


def kd_shards(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Puts every document into one of ``shards`` shards of near-equal bytes.

    Returns (doc_id, size, text_crc32, law, shard, slot, grown_shard): size is the UTF-8 bytes of the text (null: none)
    plus 1, law is ``bytes``, slot counts from 0 in each shard without a gap, grown_shard is null. Equal texts share
    coordinates, so they stay in one shard but where a cut that spares them would miss the median by more than
    ``TOLERANCE`` of a shard: a group larger than that is divided by doc_id. Null ids and null metadata
    are values of their own, repeated rows are rows, and an empty table gives no rows.
    """
    points = _points(docs, doc_id, text, lang, source)
    total = points.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    nodes, whole, tree = {0: shards}, {}, points.withColumn("node", F.lit(0))
    while any(leaves > 1 for leaves in nodes.values()) and total["n"]:
        split = {n: (leaves // 2, leaves) for n, leaves in nodes.items() if leaves > 1}
        left = _cuts(tree, split, total["bytes"] / shards, whole)
        step = max(nodes) + 1
        split = {n: v for n, v in split.items() if n in left}
        moved = reduce(lambda out, n: out.when((F.col("node") == n) & ~left[n], F.lit(n + step)), left, F.when(F.lit(False), F.lit(0)))
        tree = cut(tree.withColumn("node", moved.otherwise(F.col("node"))))
        nodes = {k: v for n, leaves in nodes.items() for k, v in (((n, split[n][0]), (n + step, leaves - split[n][0])) if n in split else ((n, 1),))}
    number = {n: k for k, n in enumerate(sorted(nodes))}
    rows = cut(tree.select(F.when(F.col("had_id"), F.col("doc_id")).alias("doc_id"), "size", "text_crc32", "row_no", _by_node("node", {n: F.lit(k) for n, k in number.items()}).alias("shard")))
    # Slots: ranges of doc_id hashes are counted first, so that no task has to number a whole shard.
    ranges = parts_for(docs.sparkSession, total["n"] // shards, ROWS_A_SLOT_RANGE)
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(ranges)))
    counts = rows.groupBy("shard", "range").count()
    counts = counts.select("shard", "range", (F.sum("count").over(Window.partitionBy("shard").orderBy("range")) - F.col("count")).alias("first"))
    slot = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "row_no")) - 1
    return rows.withColumn("own", slot).join(counts, ["shard", "range"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
