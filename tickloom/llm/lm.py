"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to the n-grams of every document.

Documents are dealt to blocks. A block sends its distinct n-grams with their counts to the hash buckets of the count
tables; a bucket sums them over the corpus and answers every block with the totals of what it sent; the block adds up the
scores of its documents. n-grams travel as sorted, delta-packed hashes, so neither text nor one row an n-gram is moved;
there are never more rows than n-grams, however many blocks and buckets there are.
A document is scored by the rest of the corpus: what it holds itself is taken off every count.
Longer n-grams are only sent if both shorter ones in them occur in other documents, as no others can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textblocks as tb
from tickloom.llm.common import WORD, parts_for, small_batches, written

ORDER, BACKOFF = 3, 0.4
#: Bits of an n-gram's hash (see score_documents for collisions); bytes of text in a block, some 16 times as much in memory.
HASH_BITS, BLOCK_BYTES = 56, 12 << 20
#: Copies of one row (id and text), in rows and bytes, that may share a block; beyond it the rows are numbered and spread.
COPIES, COPY_BYTES = 1_000, 1 << 20

_SENT = "block long, bucket long, n long, number long, hashes binary, counts binary"
_ANSWER = "block long, bucket long, n long, number long, mask binary, totals binary"


def pack(values: np.ndarray) -> bytes:
    """Sorted integers as differences of as few bytes as the largest needs; the first byte says how many."""
    step = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 8
    if len(step):
        step[0] = 0
    return bytes([width]) + (int(values[0]) if len(values) else 0).to_bytes(8, "little") + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    body = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body), 8), np.uint8)
    step[:, :width] = body
    return np.cumsum(step.reshape(-1).view("<u8")) + np.uint64(int.from_bytes(data[1:9], "little"))


def small(values: np.ndarray) -> bytes:
    """Numbers in the narrowest unsigned type that holds them, any negative ones in 8 bytes; the first byte says which."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or (int(values.min()) >= 0 and int(values.max()) < 1 << (8 * w)))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of hashes of HASH_BITS: ranges of equal width, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(HASH_BITS - 24)).astype(np.int64)


def filled(bucket: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each bucket's entries begin and end in a sorted column of buckets; buckets without any aren't walked."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts, len(bucket))[1:]
    return dict(zip(bucket[starts].tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))


class Block:
    """The n-grams of a block of texts: for each n the distinct hashes, and the place of every occurrence among them."""

    def __init__(self, texts: pa.Array, order: int, buckets: int):
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in tb.slices(texts):
            starts, ends, first = tb.spans(data, offsets)
            hashes.append(tb.span_hashes(data, starts, ends))
            counts.append(np.diff(first))
        word, self.words = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.words)])
        left = np.repeat(self.first[1:], self.words) - np.arange(len(word))  # words from here to the text's end
        self.buckets, self.distinct, self.place, self.count, self.at, long = buckets, {}, {}, {}, {}, word
        for n in range(1, order + 1):
            if n > 1:
                long = tb.mixed(long * np.uint64(0xD1342543DE82EF95) + np.concatenate([word[n - 1 :], np.zeros(min(n - 1, len(word)), np.uint64)]) + np.uint64(n))
            self.at[n] = np.flatnonzero(left >= n).astype(np.int32)  # where n-grams begin
            self.distinct[n], place, count = np.unique(long[self.at[n]] >> np.uint64(64 - HASH_BITS), return_inverse=True, return_counts=True)
            self.place[n], self.count[n] = place.astype(np.int32), count.astype(np.int32)
            del place, count
        del word, left, long
        tb.release()

    def send(self, n: int, block: int, wanted: np.ndarray | None) -> list[dict]:
        rows = []
        for b, (s, e) in filled(bucket_of(self.distinct[n], self.buckets)).items():
            pick = np.arange(s, e) if wanted is None else s + np.flatnonzero(wanted[s:e])
            if len(pick):
                rows.append({"block": block, "bucket": b, "n": n, "number": len(pick), "hashes": pack(self.distinct[n][pick]), "counts": small(self.count[n][pick])})
        return rows

    def own(self, n: int) -> np.ndarray:
        """How often the text of each occurrence has its n-gram."""
        if len(self.distinct[n]) == len(self.place[n]):
            return np.ones(len(self.place[n]), np.int64)
        text = np.repeat(np.arange(len(self.words), dtype=np.int32), self.words)[self.at[n]]
        out = np.ones(len(text), np.int64)
        some = np.flatnonzero(self.count[n][self.place[n]] > 1)  # the others occur once in the block
        _, place, count = np.unique(text[some] * np.int64(len(self.distinct[n])) + self.place[n][some], return_inverse=True, return_counts=True)
        out[some] = count[place]
        return out

    def elsewhere(self, n: int, answers: list[dict], wanted: np.ndarray | None) -> np.ndarray:
        """How often other texts have each occurrence's n-gram."""
        total, bounds = np.zeros(len(self.distinct[n]), np.int64), filled(bucket_of(self.distinct[n], self.buckets))
        for r in answers:
            if r["n"] == n:
                s, e = bounds[r["bucket"]]
                pick = np.arange(s, e) if wanted is None else s + np.flatnonzero(wanted[s:e])
                total[pick[np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["number"]).astype(bool)]] = unsmall(r["totals"])
        return np.maximum(total[self.place[n]] - self.own(n), 0)

    def wanted(self, n: int, shorter: np.ndarray) -> np.ndarray:
        """Which distinct n-grams have an occurrence both of whose (n - 1)-grams other texts have (shorter: how often).

        An n-gram of two texts is wanted wherever it occurs, so its total is whole; one of a single text counts 0 either way.
        """
        seen = np.zeros(len(self.words) and self.first[-1] + 1, bool)
        seen[self.at[n - 1]] = shorter > 0
        out = np.zeros(len(self.distinct[n]), bool)
        out[self.place[n][seen[self.at[n]] & seen[self.at[n] + 1]]] = True
        return out


def _known(block: Block, upto: int, answers: list[dict]) -> tuple[dict[int, np.ndarray], np.ndarray | None]:
    """Counts in other texts for n <= upto, and which (upto + 1)-grams to send."""
    counts, wanted = {}, None
    for n in range(1, upto + 1):
        counts[n] = block.elsewhere(n, answers, wanted)
        if n >= 2 and n + 1 in block.place:
            wanted = block.wanted(n + 1, counts[n])
    return counts, wanted


def dealt_to_blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    """``rows`` (doc_id, text) with their ``block``: by a hash of what a row holds, so that a task that runs again deals alike.

    Where many copies of one row would share a block, the rows are written with numbers first, and those play a part too.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    copies = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).where("n > 1")
    most = copies.agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
    if (most["n"] or 0) > COPIES or (most["bytes"] or 0) > COPY_BYTES:
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        key = F.xxhash64(key, "row")
    return rows.withColumn("block", F.pmod(key, F.lit(n_blocks))).select("doc_id", "text", "block").repartition(n_blocks, "block")


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_backed_off, log_score) for every document, with counts over all documents.

    A word scores log(c(n-gram) / c(context)) for the longest n-gram ending in it, within its text and of at most
    ``order`` words, that another document has; every shorter step adds log(backoff); a single word scores log(c(word) /
    words), where a word of no other document counts once. All counts are those of the other documents: what a document
    holds itself is taken off, so that it doesn't vouch for itself. n_backed_off counts the words whose longest n-gram no
    other document has. Words are runs of anything but ASCII white space. Null and empty texts score 0; each row is a
    document, so that repeated rows vouch for each other; ties don't arise, an empty table gives no rows and further columns
    play no part. n-grams are told apart by HASH_BITS of a hash: among 10**12 distinct ones a single one shares its count
    with another with a chance of 1 in 70,000.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = parts_for(spark, total["bytes"] or 0, BLOCK_BYTES)
    penalty, corpus = float(np.log(backoff)), max(total["words"] or 0, 1)
    dealt = dealt_to_blocks(rows, n_blocks)
    sent, answer = (pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in x.split(", ")]) for x in (_SENT, _ANSWER))

    def send_first(table: pa.Table) -> pa.Table:
        block = Block(table["text"], min(2, order), n_blocks)
        return pa.Table.from_pylist([r for n in block.place for r in block.send(n, table["block"][0].as_py(), None)], sent)

    def send_next(n: int):
        def send(table: pa.Table, answers: pa.Table) -> pa.Table:
            if not table.num_rows:
                return sent.empty_table()
            block = Block(table["text"], n, n_blocks)
            return pa.Table.from_pylist(block.send(n, table["block"][0].as_py(), _known(block, n - 1, answers.to_pylist())[1]), sent)

        return send

    def add_up(table: pa.Table) -> pa.Table:
        out, rows = [], table.to_pylist()
        for n in sorted({r["n"] for r in rows}):
            some = [r for r in rows if r["n"] == n]
            hashes = [unpack(r["hashes"]) for r in some]
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            counts = np.bincount(place, np.concatenate([unsmall(r["counts"]) for r in some])).astype(np.int64)
            end = np.cumsum([len(h) for h in hashes])
            for r, s, e in zip(some, end - [len(h) for h in hashes], end, strict=True):
                own = counts[place[s:e]]
                kept = own > 1  # of the others the asking text has the only one
                out.append({k: r[k] for k in ("block", "bucket", "n", "number")} | {"mask": np.packbits(kept).tobytes(), "totals": small(own[kept])})
        return pa.Table.from_pylist(out, answer)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        out_schema = pa.schema([table.schema.field("doc_id"), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score", pa.float64())])
        if not table.num_rows:
            return out_schema.empty_table()
        block = Block(table["text"], order, n_blocks)
        counts, _ = _known(block, order, answers.to_pylist())
        size = int(block.first[-1])
        place = np.arange(size) - np.repeat(block.first[:-1], block.words)  # of a word in its text
        longest = np.minimum(place + 1, order)
        value, used = np.zeros(size), np.zeros(size, np.int64)
        for n in range(1, order + 1):
            count = np.zeros(size, np.int64)  # of the n-gram ending in each word
            count[block.at[n] + n - 1] = counts[n]
            if n == 1:
                value, used = np.log(np.maximum(count, 1) / np.maximum(corpus - np.repeat(block.words, block.words), 1)), np.ones(size, np.int64)
            else:
                some = count > 0
                before = np.roll(shorter, 1)  # the context ends in the word before
                value[some], used[some] = np.log(count[some] / np.maximum(before[some], 1)), n
            shorter = count
        value += (longest - used) * penalty
        text_of = np.repeat(np.arange(len(block.words)), block.words)
        add = lambda x: np.bincount(text_of, x, len(block.words))
        return pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(block.words), pa.array(add(used < longest).astype(np.int64)), pa.array(add(value))], schema=out_schema)

    out_type = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_backed_off")), T.StructField("log_score", T.DoubleType())])
    answers = dealt.groupBy("block").applyInArrow(send_first, _SENT).groupBy("bucket").applyInArrow(add_up, _ANSWER)
    for n in range(3, order + 1):
        more = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send_next(n), _SENT)
        answers = answers.unionAll(more.groupBy("bucket").applyInArrow(add_up, _ANSWER))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out_type)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS c, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, c, lag(c) OVER o AS b, lag(c, 2) OVER o AS a FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT c, count(*) AS n1 FROM g GROUP BY c),
k AS (SELECT b, c, count(*) AS n2 FROM g WHERE b IS NOT NULL GROUP BY ALL),
r AS (SELECT a, b, c, count(*) AS n3 FROM g WHERE a IS NOT NULL GROUP BY ALL),
own AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS words, count(*) OVER (PARTITION BY doc_id, c) AS o1,
    count(*) OVER (PARTITION BY doc_id, b, c) AS o2, count(*) OVER (PARTITION BY doc_id, a, b, c) AS o3 FROM g),
e AS (SELECT own.doc_id, own.i, words, n1 - o1 AS e1, coalesce(n2 - o2, 0) AS e2, coalesce(n3 - o3, 0) AS e3
    FROM own JOIN u ON own.c = u.c LEFT JOIN k ON own.b = k.b AND own.c = k.c LEFT JOIN r ON own.a = r.a AND own.b = r.b AND own.c = r.c),
f AS (SELECT *, lag(e1) OVER o AS before1, lag(e2) OVER o AS before2 FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, least(i + 1, 3) AS longest, CASE WHEN e3 > 0 THEN 3 WHEN e2 > 0 THEN 2 ELSE 1 END AS used,
    CASE WHEN e3 > 0 THEN ln(e3 / before2) WHEN e2 > 0 THEN ln(e2 / before1)
    ELSE ln(greatest(e1, 1) / greatest((SELECT count(*) FROM t) - words, 1)) END AS value FROM f)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN used < longest THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_backed_off,
    round(coalesce(sum(value + (longest - used) * ln(0.4)), 0), 4) + 0.0 AS log_score
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id, len(d.w)
"""
