"""Language identification by cross-parsing: the language whose text explains a document in the fewest phrases.

A suffix automaton of labelled text for each language gives the longest match from any place; a document is parsed
greedily into such matches, and phrases are counted for each language, weighed by the logarithm of the length of its
text, as a short text has short matches. Documents are parsed in columns: all segments of
a slice advance one letter at a time through one table of transitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.llm import textblocks as tb
from tickloom.llm.common import fold, small_batches

#: The labelled sample of a language: so many documents at most, and so many letters of them.
SAMPLE_DOCS, SAMPLE_LETTERS = 24, 40_000
#: The most languages that are learned (those of most labelled documents), and the most letters of all samples: their
#: automata, at most 2 states a letter and 157 transitions of four bytes a state, are held in each worker.
LANGUAGES, ALL_LETTERS = 200, 400_000
#: A phrase weighs as if the sample had at least so many letters, so that a language of which next to nothing was
#: learned, where each letter is a phrase, can't be the cheapest by the lightness of its phrases.
LEAST_LETTERS = 128
#: Phrases end at segment ends: documents are parsed in segments of so many letters.
SEGMENT = 1024
#: Bytes of text whose segments advance together.
PARSED = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case text as letters with single spaces for all between, and the new offsets."""
    keep = _LETTER[data]
    space = ~keep
    space[1:] &= keep[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    space[edge] = False
    out = np.where(keep, data, 32)
    kept = keep | space
    before = np.concatenate([[0], np.cumsum(kept)])
    return out[kept].astype(np.uint8), before[offsets]


def automaton(text: bytes, code: list[int], width: int) -> np.ndarray:
    """Transitions (states x width) of the suffix automaton of ``text``: state 1 is the root, 0 is no transition."""
    link, length, nxt = [0, 0], [0, 0], [None, [0] * width]
    last = 1
    for byte in text:
        c = code[byte]
        new = len(length)
        length.append(length[last] + 1)
        link.append(1)
        nxt.append([0] * width)
        p = last
        while p and not nxt[p][c]:
            nxt[p][c] = new
            p = link[p]
        if p:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt.append(nxt[q][:])
                link[q] = link[new] = clone
                while p and nxt[p][c] == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = new
    nxt[0] = [0] * width
    return np.array(nxt, np.int32)


@lru_cache(maxsize=2)
def _tables(samples: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(transitions of all languages below one another, each root, code of each byte, width). State 0 has none."""
    seen = sorted(set(b"".join(text for _, text in samples)))
    width = len(seen) + 1
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, width)
    tables, roots, at = [], [], 0
    for _, text in samples:
        table = automaton(text, code.tolist(), width)
        table[table > 0] += at
        roots.append(at + 1)
        at += len(table)
        tables.append(table)
    return np.concatenate(tables).ravel(), np.array(roots), code, width


def phrases(data: np.ndarray, offsets: np.ndarray, samples: tuple[tuple[str, bytes], ...]) -> np.ndarray:
    """The number of phrases of each text (rows) in each language (columns)."""
    table, roots, code, width = _tables(samples)
    length = np.diff(offsets)
    pieces = -(-length // SEGMENT)
    of = np.repeat(np.arange(len(length)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[:-1][of] + number * SEGMENT
    size = np.minimum(offsets[1:][of] - start, SEGMENT)
    order = np.argsort(-size, kind="stable")
    start, size, of = start[order], size[order], of[order]
    counts = np.zeros((len(roots), len(of)), np.int32)
    state = np.zeros((len(roots), len(of)), np.int32)
    codes = code[data]
    fresh = table.reshape(-1, width)[roots]  # where a phrase that begins with a letter leads
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        c = codes[start[:live] + t]
        for k in range(len(roots)):
            s = table[state[k, :live] * np.int64(width) + c]
            ended = s == 0
            counts[k, :live] += ended
            state[k, :live] = np.where(ended, fresh[k][c], s)
    return np.column_stack([np.bincount(of, row, len(length)) for row in counts]).astype(np.int64)


def learn(docs: DataFrame, test_fold: int | None = 0, folds: int = 5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[tuple[str, bytes], ...]:
    """(language, letters of labelled text) for each language, from documents outside ``test_fold``.

    The sample is bounded: SAMPLE_DOCS whole documents for each language (first those of 200 to 4,000 characters, in the
    order of a hash of their id), joined and ended at SAMPLE_LETTERS bytes. Of a longer text only its first 4 *
    SAMPLE_LETTERS characters can count, so no more of it reaches the driver. At most LANGUAGES are learned, and samples
    are shortened alike where they would be more than ALL_LETTERS together.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = rows if test_fold is None else rows.where(fold("doc_id", folds) != test_fold)
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    rows = rows.join(F.broadcast(most), "lang", "left_semi")
    order = Window.partitionBy("lang").orderBy((~F.length("text").between(200, 4000)).cast("int"), F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "text")
    picked = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SAMPLE_DOCS).select("lang", "turn", F.left("text", F.lit(4 * SAMPLE_LETTERS)).alias("text")).orderBy("lang", "turn")
    by_lang: dict[str, list[str]] = {}
    for r in picked.toLocalIterator():
        by_lang.setdefault(r["lang"], []).append(r["text"].lower())
    samples, share = [], min(SAMPLE_LETTERS, ALL_LETTERS // max(len(by_lang), 1))
    for name, texts in sorted(by_lang.items()):
        data, offsets = tb.utf8(pa.array(texts))
        samples.append((name, letters(data, offsets)[0][:share].tobytes()))
    return tuple(samples)


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every document.

    A language's phrases are normalised to those of the longest sample: times log2 of its own letters, LEAST_LETTERS at
    least, by log2 of the most. A language whose sample has no letter breaks a phrase at each letter, and so never wins.
    The language with the fewest wins, the first by name on a tie; score weighs every phrase more than the
    winner's by a half: 1 / sum(2 ** -(phrases - fewest)). Texts that are null or have no letter are ``und`` with score 0,
    and so are all texts if no language was learned.
    """
    small_batches(docs.sparkSession)
    names = [name for name, _ in samples]
    weight = np.log2([max(len(sample), LEAST_LETTERS) for _, sample in samples])
    weight = weight / weight.max() if names else weight
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most SAMPLE_LETTERS bytes a language

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))
            for row, end, data, offsets in tb.slices(pc.utf8_lower(column), PARSED):
                found = lettered[row:end] & bool(names)
                pred, score = np.full(end - row, "und", object), np.zeros(end - row)
                if found.any():
                    count = phrases(*letters(data, offsets), shared.value) * weight
                    best = count.argmin(1)
                    sure = 1 / np.exp2(-(count - count.min(1)[:, None])).sum(1)
                    pred[found], score[found] = np.array(names, object)[best][found], sure[found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(parse, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): rows of fold 0 of 5 are held out of the labelled sample.

    Null ids count as empty in the fold, repeated rows have a row each, an empty table gives no rows; further columns play no part.
    """
    out = identify(docs, learn(docs, 0, 5, doc_id, text, lang), doc_id, text)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
