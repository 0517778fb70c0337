"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash bucket; a running sum over the buckets finds the bucket in which a source's budget
ends, and only that bucket is split further, until the threshold is one hash value. Taking is then a filter on the
hash: documents are never sorted. Thresholds are nested: a larger budget keeps all that a smaller one took.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import WORD, cut

#: The hash has 60 bits: five rounds of 12.
BITS, ROUNDS = 12, 5


def hash60(doc_id: str, text: str):
    """60 bits of the md5 of the id; rows without an id take their text's md5."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.col(text).cast("binary"))), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size) with each source's target: water-filling of the total by weight, at most cap * source_size.

    Sources take ``weights`` in turn by code point, null last. One row a source, so its windows are small. A source of
    no words has target 0.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    return (
        sizes.withColumn("turn", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("room", F.col("most") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "level"))).over(everywhere)["level"])
        .select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))
    )


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, threshold): documents with hash60 < threshold hold about ``need`` words of their source.

    docs: (source, size, h); goals: (source, need). The document at the end is in if more than half of it is needed.
    """
    shift = BITS * ROUNDS
    edge = goals.where("need > 0").select(F.col("source").alias("of"), F.lit(0).cast("long").alias("prefix"), "need")
    for _ in range(ROUNDS):
        inside = docs.join(edge, docs["source"].eqNullSafe(edge["of"]) & (F.shiftright(docs["h"], shift) == edge["prefix"]))
        shift -= BITS
        sums = inside.groupBy("of", "need", F.shiftright("h", shift).alias("prefix")).agg(F.sum("size").alias("words")).where("words > 0")
        so_far = F.sum("words").over(Window.partitionBy("of").orderBy("prefix"))
        sums = sums.withColumn("so_far", so_far).where((F.col("so_far") >= F.col("need")) & (F.col("so_far") - F.col("words") < F.col("need")))
        edge = sums.select("of", "prefix", (F.col("need") - F.col("so_far") + F.col("words")).alias("need"), "words")
    return edge.select(F.col("of").alias("source"), (F.col("prefix") + (F.col("need") * 2 > F.col("words")).cast("long")).alias("threshold"))


#: A plan of so many sources is small enough to broadcast (about 100 bytes each).
BROADCAST_SOURCES = 20_000


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, h), and for each source (of, source_size, target, passes, threshold)."""
    rows = cut(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), F.coalesce(F.regexp_count(docs[text], F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash60(doc_id, text).alias("h")))
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    by_source = by_source.withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    by_source = cut(by_source.withColumn("need", F.col("target") - F.col("passes") * F.col("source_size")))
    ends = thresholds(rows.select("source", "size", "h"), by_source.select("source", "need"))
    return rows, cut(by_source.alias("s").join(ends.alias("e"), F.col("s.source").eqNullSafe(F.col("e.source")), "left").select(F.col("s.source").alias("of"), "source_size", "target", "passes", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def _small(by_source: DataFrame) -> DataFrame:
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document.

    Returns (doc_id, size, source_size, target, taken, source, copies): size counts the words of the whole text
    (null: 0), copies is the number of times that the document is taken (0 to ceil(cap)), taken = copies * size.
    A target of k whole passes over a source and a rest takes every document k times, and once more those below the
    source's hash threshold. Empty texts have size 0 and follow the same rule. Rows with equal ids have equal hashes
    and are taken alike; null sources are one source; an empty table gives no rows.
    """
    rows, by_source = plan(docs, weights, cap, doc_id, text, source)
    copies = F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")
    return rows.join(_small(by_source), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))


def take(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as ``mix`` takes it, with its columns as they were.

    Nulls, empty texts, repeated rows and empty tables are as in mix(); columns may have any names.
    """
    _, by_source = plan(docs, weights, cap, doc_id, text, source)
    # a struct keeps the rows' own columns apart from the plan's
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs[source].alias("source"), hash60(doc_id, text).alias("h"))
    taken = rows.join(_small(by_source), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", F.col("passes") + (F.col("h") < F.col("threshold")).cast("long")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
r AS (SELECT *, most / weight AS room FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(most) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, room) FROM l WHERE level <= room) * weight, most)) AS target FROM l),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
n AS (SELECT *, target - passes * source_size AS need FROM p),
h AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY ALL),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS so_far FROM h),
e AS (SELECT c.source, max(CASE WHEN (need - so_far + words) * 2 > words THEN h + 1 ELSE h END) AS threshold
    FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE so_far >= need AND so_far - words < need GROUP BY ALL)
SELECT d.doc_id, d.source, d.size, n.source_size, n.target, passes + CASE WHEN d.h < coalesce(threshold, 0) THEN 1 ELSE 0 END AS copies,
    CAST((passes + CASE WHEN d.h < coalesce(threshold, 0) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
