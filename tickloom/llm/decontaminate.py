"""Benchmark decontamination: every passage of the corpus queries a BM25 index of the test items with block-max WAND.

Impacts are BM25 contributions divided by the item's score against itself, so a threshold is the share of an item that a
passage must hold. Passages whose best possible score stays below the threshold have no pivot and are passed over for a
whole batch at once; the rest run the document-at-a-time search. Items found are verified: the document must hold
enough of the term shingles of the item's question and of its answer, or nearly all of the whole item's.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textblocks as tb
from tickloom.llm.common import cut, place, small_batches, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of the shingles of question and answer.
THRESHOLD, OVERLAP = 0.5, 0.5
#: Share of all shingles of an item that is enough by itself: an answer of few shingles may be damaged then.
WHOLE = 0.8
#: Words of a verified shingle; postings of a block; the shortest passage.
SHINGLE, BLOCK, PASSAGE = 3, 4, 128
#: Passages whose block bounds are summed at once.
WINDOWS = 512
#: Postings of one broadcast index (about 100 bytes each); more items than that are split over several indexes.
INDEX_POSTINGS = 250_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
#: Where a sentence ends: at a mark before white space, or at one of a script that is written without spaces.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


def _before(x: np.ndarray) -> np.ndarray:
    """Each place's value one place before."""
    return np.concatenate([np.zeros(1, bool), x[:-1]])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms of lower-case UTF-8 and each text's first term.

    Terms are runs of letters and digits; a character of three or more bytes (scripts that may be written without
    spaces) is a term of its own, but the punctuation among these only separates.
    """
    lead = data >= 0xE0
    long = lead | _before(lead) | _before(_before(lead)) | _before(_before(_before(data >= 0xF0)))
    second = np.append(data[1:], 0)
    mark = ((data == 0xE2) & (second <= 0x81)) | ((data == 0xE3) & (second == 0x80)) | ((data == 0xEF) & (second >= 0xBC) & (second <= 0xBD))
    inside = _WORD_BYTE[data] & ~(mark | _before(mark) | _before(_before(mark)))
    begins = inside & (~_before(inside) | lead | (_before(long) & ~long))
    edge = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[edge] = inside[edge]
    ends = inside & np.append(~inside[1:] | begins[1:], True) if len(data) else inside
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, term hashes, each text's first term) of lower-cased texts."""
    for row, end, data, offsets in tb.slices(pc.utf8_lower(column)):
        starts, ends, first = _terms(data, offsets)
        yield row, end, tb.span_hashes(data, starts, ends), first


def _hashes(texts: list[str]) -> list[np.ndarray]:
    """The term hashes of each text."""
    return [h[first[i] : first[i + 1]] for _, _, h, first in words(pa.array(texts, pa.string())) for i in range(len(first) - 1)]


def question_terms(text: str) -> int:
    """How many of an item's terms are its question: the fewest last sentences with SHINGLE terms at least are its answer.

    An item whose sentences leave no question of that size is halved.
    """
    number = [len(h) for h in _hashes(_SENTENCE.split(text.strip()))]
    for k in range(len(number) - 1, 0, -1):
        if sum(number[k:]) >= SHINGLE and sum(number[:k]) >= SHINGLE:
            return sum(number[:k])
    return sum(number) // 2


def shingles(terms: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of the runs of ``n`` terms; none if there are fewer."""
    return np.unique(tb.grams(terms, np.array([0, len(terms)]), n)[0]) if len(terms) >= n > 0 else np.zeros(0, np.uint64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, row, n_words, term, tf, question, answer, whole): a row for each term, sides on the item's first row only.

    A side is its number of terms or SHINGLE, whichever is less, and the hashes of its runs of so many.
    """
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        out = []
        for item, row, text, h in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, _hashes(texts), strict=True):
            terms, tf = np.unique(h, return_counts=True)
            cut_at = question_terms(text)
            sides = []
            for side in (h[:cut_at], h[cut_at:], h):
                n = min(SHINGLE, len(side))
                sides.append([n, *shingles(side, n).view(np.int64).tolist()])
            for k, (t, c) in enumerate(zip(terms.view(np.int64).tolist(), tf.tolist(), strict=True)):
                out.append({"item": item, "row": row, "n_words": len(h), "term": t, "tf": c, **dict(zip(("question", "answer", "whole"), [None] * 3 if k else sides, strict=True))})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("item", batch.schema.types[0]), ("row", pa.int64()), ("n_words", pa.int64()), ("term", pa.int64()), ("tf", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("question", "answer", "whole"))]))


class Index:
    """An inverted index of items: impacts by term in item order, with the largest of each list and block."""

    def __init__(self, rows: list, n_items: int, mean_words: float):
        items: dict[tuple, list] = {}
        for r in rows:
            items.setdefault(r["row"], []).append(r)
        self.ids, self.sides, lists = [], [], {}
        self.longest = max([1, *(r["n_words"] for r in rows)])
        for k, (_, terms) in enumerate(sorted(items.items())):
            head = next(r for r in terms if r["question"] is not None)
            self.ids.append(head["item"])
            self.sides.append(tuple((head[s][0], np.array(head[s][1:], np.int64).view(np.uint64)) for s in ("question", "answer", "whole")))
            weigh = [math.log(1 + (n_items - r["df"] + 0.5) / (r["df"] + 0.5)) * r["tf"] * (K1 + 1) / (r["tf"] + K1 * (1 - B + B * r["n_words"] / mean_words)) for r in terms]
            own = sum(weigh)
            for r, w in zip(terms, weigh, strict=True):
                lists.setdefault(r["term"], []).append((k, w / own))
        vocabulary = np.array(sorted(t & (2**64 - 1) for t in lists), np.uint64)
        self.vocabulary = vocabulary
        ordered = [lists[t] for t in vocabulary.view(np.int64).tolist()]
        self.items = [[k for k, _ in x] for x in ordered]
        self.impacts = [[w for _, w in x] for x in ordered]
        self.most = np.array([max(w) for w in self.impacts] or [0.0])
        self.blocks = [[max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for w in self.impacts]
        # the same block bounds by ranges of items, for all passages of a batch at once
        self.ranges = -(-max(len(self.ids), 1) // BLOCK)
        keys = sorted({(t, k // BLOCK) for t, x in enumerate(self.items) for k in x})
        top = {}
        for t, (x, w) in enumerate(zip(self.items, self.impacts, strict=True)):
            for k, v in zip(x, w, strict=True):
                top[t, k // BLOCK] = max(v, top.get((t, k // BLOCK), 0.0))
        self.range_of, self.range_most = np.array([r for _, r in keys], np.int64), np.array([top[x] for x in keys])
        self.range_first = np.searchsorted(np.array([t for t, _ in keys], np.int64), np.arange(len(ordered) + 1))

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their numbers."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == hashes if len(self.vocabulary) else np.zeros(len(hashes), bool)
        return known, at[known]

    def _reach(self, terms: np.ndarray, begin: np.ndarray, end: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the passages terms[begin:end] could reach the threshold in any block of items."""
        number = end - begin
        mine = terms[np.repeat(begin - np.cumsum(number) + number, number) + np.arange(number.sum())]
        size = self.range_first[mine + 1] - self.range_first[mine]
        rows = np.repeat(self.range_first[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
        passage = np.repeat(np.repeat(np.arange(len(begin)), number), size)
        bounds = np.bincount(passage * self.ranges + self.range_of[rows], self.range_most[rows], len(begin) * self.ranges)
        return bounds.reshape(len(begin), self.ranges).max(1) >= threshold - 1e-9

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with a score of at least ``threshold``, by block-max WAND."""
        found, floor = [], threshold - 1e-9
        cursor = [[self.items[t][0], 0, t] for t in terms]
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursor):
                bound += self.most[c[2]]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == item:
                pivot += 1
            bound, after = 0.0, cursor[pivot + 1][0] if pivot + 1 < len(cursor) else len(self.ids)
            for _, at, t in cursor[: pivot + 1]:
                at = bisect_left(self.items[t], item, at)
                if at < len(self.items[t]):
                    bound += self.blocks[t][at // BLOCK]
                    after = min(after, self.items[t][min((at // BLOCK + 1) * BLOCK, len(self.items[t])) - 1] + 1)
            if bound < floor:
                goal = max(after, item + 1)
            else:
                if cursor[0][0] == item:
                    score = sum(self.impacts[t][at] for _, at, t in cursor[: pivot + 1])
                    if score >= floor:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            moved = []
            for c in cursor[: pivot + 1]:
                if c[0] < goal:
                    c[1] = bisect_left(self.items[c[2]], goal, c[1])
                    if c[1] == len(self.items[c[2]]):
                        continue
                    c[0] = self.items[c[2]][c[1]]
                moved.append(c)
            cursor = moved + cursor[pivot + 1 :]
        return found

    def candidates(self, hashes: np.ndarray, first: np.ndarray, passage: int, threshold: float) -> dict[int, dict[int, float]]:
        """For each text with items above the threshold: the best score of each in any of its passages.

        Passages have ``passage`` words and begin every half passage.
        """
        out: dict[int, dict[int, float]] = {}
        known, term = self.terms(hashes)
        at = np.flatnonzero(known)
        text = np.searchsorted(first, at, "right") - 1
        place = at - first[text]
        for shift in (0, passage // 2):
            number = (place + shift) // passage
            most = int(number.max()) + 1 if len(number) else 1
            pair = np.unique((text * most + number) * len(self.vocabulary) + term)
            window, t = pair // max(len(self.vocabulary), 1), pair % max(len(self.vocabulary), 1)
            begin = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
            if not len(begin):
                continue
            end = np.append(begin[1:], len(window))
            live = np.flatnonzero(np.add.reduceat(self.most[t], begin) >= threshold - 1e-9)
            live = np.concatenate([some[self._reach(t, begin[some], end[some], threshold)] for some in np.split(live, range(WINDOWS, len(live), WINDOWS))])
            for b, e in zip(begin[live].tolist(), end[live].tolist(), strict=True):
                for item, score in self.search(t[b:e].tolist(), threshold):
                    best = out.setdefault(int(window[b]) // most, {})
                    best[item] = max(score, best.get(item, 0.0))
        return out


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator:
    """Indexes that together hold all items, one after the other, none with more than about INDEX_POSTINGS postings."""
    rows = benchmark.select(benchmark[item_id].alias("item"), benchmark[text].alias("text"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    kind = T.StructType([rows.schema["item"], rows.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "term", "tf")), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("question", "answer", "whole"))])
    terms = cut(rows.mapInArrow(_item_rows, kind))
    whole = terms.agg(F.count("*").alias("postings"), F.sum(F.col("question").isNotNull().cast("long")).alias("items"), F.sum("tf").alias("words")).first()
    if not whole["postings"]:
        return
    parts = -(-whole["postings"] // INDEX_POSTINGS)
    full = cut(terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term"))
    for k in range(parts):
        yield benchmark.sparkSession.sparkContext.broadcast(Index(full.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == k).collect(), whole["items"], whole["words"] / whole["items"]))


def _hits(column: pa.Array, shared, threshold: float, overlap: float) -> Iterator[tuple[int, object, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of the verified items of a batch."""
    index = shared.value
    passage = max(PASSAGE, 2 * index.longest)
    for row, _, hashes, first in words(column):
        for text, items in index.candidates(hashes, first, passage, threshold).items():
            held: dict[int, np.ndarray] = {}

            def share(side: tuple[int, np.ndarray], terms=hashes[first[text] : first[text + 1]], held=held) -> float:
                n, wanted = side
                if n and n not in held:
                    held[n] = shingles(terms, n)
                return float(np.isin(wanted, held[n], assume_unique=True).mean()) if n else 1.0

            for item, score in sorted(items.items()):
                q, a, whole = map(share, index.sides[item])
                if (q >= overlap and a >= overlap) or whole >= WHOLE:
                    yield row + text, index.ids[item], score, q, a


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each test item found in each document.

    Whole texts are searched, in passages of at least twice the longest item that begin every half passage, so an item
    that a document holds in one piece lies in one passage. An item counts if the document holds ``overlap`` of the runs
    of SHINGLE terms of its question and of its answer, or WHOLE of all its runs; a side of fewer terms must occur as it
    is, one after the other. Null and empty texts and items find nothing; every item of several equal ones has its row, and
    repeated rows each have their rows; an empty table on either side finds nothing; further columns play no part.
    Documents are scanned once for each index of INDEX_POSTINGS postings, so memory doesn't grow with the benchmark.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", benchmark.schema[item_id].dataType), *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    kind = benchmark.select(item_id).limit(0).toArrow().schema.types[0]

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(_hits(batch.column(1), shared, threshold, overlap))
                at, item, *rest = zip(*hits, strict=True) if hits else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, kind), *(pa.array(x, pa.float64()) for x in rest)], schema.names)

        return run

    out = None
    for shared in indexes(benchmark, item_id, item_text):
        found = rows.mapInArrow(search(shared), schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item as in leaks(), all columns as they were.

    Null and empty texts stay, repeated rows go or stay together, an empty benchmark keeps all. With several indexes
    what one leaves is written before the next searches it.
    """
    small_batches(docs.sparkSession)
    at = place(docs, text)

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                kept[[h[0] for h in _hits(batch.column(at), shared, threshold, overlap)]] = False
                yield batch.filter(pa.array(kept))

        return run

    out, several = docs, False
    for shared in indexes(benchmark, item_id, item_text):
        out = (written(out, "clean") if several else out).mapInArrow(keep(shared), docs.schema)
        several = True
    return out
