"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text is a set of paragraph digests, a repeated paragraph counting again as its second, third, ... occurrence. Each
digest is added to one cell of each third of a sketch: a count, the xor of digests and the xor of their checksums.
Subtracting the sketches of two versions cancels what they share. A cell with one digest left gives it away; taking it
out of its other cells frees more, until the sketch is empty and all differing digests are known. If that fails, both
versions are sketched again with three times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm.common import only, small_batches, written
from tickloom.llm.textblocks import SLICE_BYTES, mixed, release, span_hashes, spans

#: Cells of a fingerprint, and by how much a failed sketch grows. A paragraph is at most so many words.
CELLS, GROWTH, PARAGRAPH_WORDS = 24, 3, 16
#: Sketches of so many cells in all are held at once, but always those of one pair.
CELLS_AT_ONCE, ROUNDS = 1 << 20, 1000
_SEEDS = [np.uint64(int.from_bytes(hashlib.sha256(bytes([k])).digest()[:8], "big")) for k in range(5)]
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of paragraphs and each text's first: words up to a line break, a sentence end or PARAGRAPH_WORDS of them."""
    starts, ends, first = spans(data, offsets)
    n = len(starts)
    breaks = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
    last = np.zeros(n, bool)
    last[:-1] = breaks[starts[1:]] > breaks[ends[:-1]]
    last |= _ENDS[data[ends - 1]]
    last[first[1:][np.diff(first) > 0] - 1] = True
    head = np.concatenate([[True], last[:-1]])[:n]
    since = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))
    head |= since % PARAGRAPH_WORDS == 0
    at = np.flatnonzero(head)
    return starts[at], ends[np.append(at[1:], n) - 1] if n else ends, np.searchsorted(at, first)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of all texts, one text after the other, and each text's first."""
    starts, ends, first = paragraphs(data, offsets)
    key, doc = span_hashes(data, starts, ends), np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((key, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.arange(len(key))
    times = at - np.maximum.accumulate(np.where(new, at, 0))
    return mixed(key[order] + times.astype(np.uint64) * _SEEDS[4]), first


def _check(key: np.ndarray) -> np.ndarray:
    return mixed(key ^ _SEEDS[3]) >> np.uint64(32)


def _places(key: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    """Three rows: the cells of each digest, one in each third of its sketch."""
    third = cells // 3
    return np.stack([(mixed(key ^ _SEEDS[k]) % np.uint64(third)).astype(np.int64) + k * third + sketch * cells for k in range(3)])


def _xor_at(into: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """into[at] ^= values, with repeated places; by one sort and a reduction."""
    order = np.argsort(at, kind="stable")
    at, values = at[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    into[at[first]] ^= np.bitwise_xor.reduceat(values, first)


def sketches(key: np.ndarray, sketch: np.ndarray, n: int, cells: int, sign: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digests and checksums of ``n`` sketches; ``sketch`` says whose each digest is."""
    count, keys, checks = np.zeros(n * cells, np.int64), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    if len(key):
        at = _places(key, sketch, cells).ravel()
        count += np.bincount(at, np.tile(np.broadcast_to(sign, key.shape), 3), n * cells).astype(np.int64)
        _xor_at(keys, at, np.tile(key, 3))
        _xor_at(checks, at, np.tile(_check(key), 3))
    return count, keys, checks


def peel(count: np.ndarray, keys: np.ndarray, checks: np.ndarray, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of ``n`` subtracted sketches came out empty, and the digests found: whose, which, and from which side (1 or -1)."""
    found = []
    todo = np.flatnonzero(count)
    for _ in range(ROUNDS):
        pure = todo[np.abs(count[todo]) == 1]
        pure = pure[_check(keys[pure]) == checks[pure]]
        if not len(pure):
            break
        key, sketch, sign = keys[pure], pure // cells, count[pure]
        order = np.lexsort((key, sketch))
        key, sketch, sign = key[order], sketch[order], sign[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (sketch[1:] != sketch[:-1])])
        key, sketch, sign = key[new], sketch[new], sign[new]
        found.append((sketch, key, sign))
        at = _places(key, sketch, cells).ravel()
        np.subtract.at(count, at, np.tile(sign, 3))
        _xor_at(keys, at, np.tile(key, 3))
        _xor_at(checks, at, np.tile(_check(key), 3))
        todo = np.unique(at)
    left = ((count != 0) | (keys != 0) | (checks != 0)).reshape(n, cells).any(axis=1)
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return ~left, *(np.concatenate([none[k], *(f[k] for f in found)]) for k in range(3))


def _of(first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the digests of ``docs``, and which of ``docs`` each belongs to."""
    size = first[docs + 1] - first[docs]
    whose = np.repeat(np.arange(len(docs)), size)
    return np.arange(len(whose)) - np.repeat(np.cumsum(size) - size, size) + first[docs][whose], whose


def differences(key: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of texts: cells that sufficed; and the digests of all differences: pair, digest, side (1: only left).

    Sizes that can't hold the difference of the two counts are passed over. A sketch of more cells than both texts have
    digests fails with vanishing chance, so the loop ends.
    """
    sizes = np.diff(first)
    least = np.abs(sizes[left] - sizes[right])
    sufficed, found = np.zeros(len(left), np.int64), []
    open_, cells = np.arange(len(left)), CELLS
    while len(open_):
        now = open_[least[open_] <= cells]
        for part in np.array_split(now, max(1, len(now) * cells // CELLS_AT_ONCE)):
            (a, whose_a), (b, whose_b) = _of(first, left[part]), _of(first, right[part])
            both, side = np.concatenate([whose_a, whose_b]), np.concatenate([np.ones(len(a), np.int64), -np.ones(len(b), np.int64)])
            diff = sketches(key[np.concatenate([a, b])], both, len(part), cells, side)
            empty, pair, digest, sign = peel(*diff, len(part), cells)
            sufficed[part[empty]] = cells
            good = empty[pair]
            found.append((part[pair[good]], digest[good], sign[good]))
        open_ = open_[sufficed[open_] == 0]
        cells *= GROWTH
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return sufficed, *(np.concatenate([none[k], *(f[k] for f in found)]) for k in range(3))


def likeness(n_left: np.ndarray, n_right: np.ndarray, n_diff: np.ndarray) -> np.ndarray:
    """Digests shared by all digests of both; two texts without any are alike."""
    either = (n_left + n_right + n_diff) // 2
    return np.where(either > 0, (either - n_diff) / np.maximum(either, 1), 1.0)


def _flat(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def edited(texts: Sequence[bytes], following: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Code points of each text, and the first len(following) texts with their last quarter replaced by the beginning of the text ``following`` names."""
    data, offsets = _flat(texts)
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where code points begin
    first = np.searchsorted(begins, offsets)
    n = np.diff(first)
    own = np.arange(len(following))
    quarter = n[own] // 4
    keep = begins[first[own] + n[own] - quarter] - offsets[own]
    take = begins[first[following] + np.minimum(quarter, n[following])] - offsets[following]
    return n, [texts[i][: keep[i]] + texts[j][: take[i]] for i, j in enumerate(following.tolist())]


def _strings(key: np.ndarray, first: np.ndarray) -> list[str]:
    """The sketches of CELLS cells as text: base64 of all counts (4 bytes), all digests (8) and all checksums (4), little end first."""
    n = len(first) - 1
    where, whose = _of(first, np.arange(n))
    fields = zip(sketches(key[where], whose, n, CELLS), ("<i4", "<u8", "<u4"), strict=True)
    parts = np.concatenate([f.astype(kind).reshape(n, CELLS).view(np.uint8).reshape(n, -1) for f, kind in fields], axis=1)
    return [base64.b64encode(row.tobytes()).decode() for row in parts]


def _results(ids: list, texts: Sequence[bytes], following: np.ndarray) -> dict[str, list]:
    """The result columns of the first len(following) texts."""
    n, m = len(following), len(texts)
    chars, changed = edited(texts, following)
    key, first = digests(*_flat([*texts, *changed]))
    own, size = np.arange(n), np.diff(first)
    cells, pair, _, _ = differences(key, first, np.tile(own, 2), np.concatenate([m + own, following]))
    near = likeness(np.tile(size[:n], 2), np.concatenate([size[m:], size[following]]), np.bincount(pair, minlength=2 * n))
    prints = _strings(key, first)
    return {
        "doc_id": ids[:n],
        "n_chars": chars[:n].tolist(),
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": prints[:n],
        "edited_fingerprint": prints[m:],
        "near_edited": near[:n].tolist(),
        "near_next": near[n:].tolist(),
        "cells_edited": cells[:n].tolist(),
        "cells_next": cells[n:].tolist(),
    }


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, cells_edited long, cells_next long"


def _slices(rows: Sequence[bytes], overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about SLICE_BYTES, each beginning ``overlap`` rows before the end of the one before."""
    at = 0
    while at < len(rows) - overlap:
        end, size = at, 0
        while end < len(rows) - overlap and (end == at or size < SLICE_BYTES):
            size += len(rows[end])
            end += 1
        yield at, end + overlap
        at = end


def _in_order(schema: pa.Schema):
    """Sorted rows (doc_id, text) to results of each row with its next one; a partition's first and last rows go along as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        blank = dict.fromkeys(schema.names)

        def made(columns: dict[str, list], kind: int) -> pa.RecordBatch:
            n = len(columns["doc_id"])
            columns = {**{name: [None] * n for name in blank}, **columns, "kind": [kind] * n, "task": [task] * n}
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        ids, texts = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            if not ids:
                yield made({"doc_id": [batch.column(0)[0].as_py()], "text": [more[0].decode("utf-8", "replace")]}, 1)
            ids, texts = ids + batch.column(0).to_pylist(), texts + more
            for a, b in _slices(texts, 1):
                yield made(_results(ids[a:b], texts[a:b], np.arange(1, b - a)), 0)
            ids, texts = ids[-1:], texts[-1:]
            release()
        if ids:
            yield made({"doc_id": ids, "text": [texts[0].decode("utf-8", "replace")]}, 2)

    return run


def _pairs(schema: pa.Schema):
    """Rows (doc_id, text, text of the next) to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts, nexts = ([t.as_py() or b"" for t in batch.column(k).cast(pa.binary())] for k in (1, 2))
            for a, b in _slices(texts, 0):
                columns = _results(ids[a:b], texts[a:b] + nexts[a:b], np.arange(b - a, 2 * (b - a)))
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        release()

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how like they and the next document's are.

    The edited text has the last quarter of its code points (rounded down) replaced by as many from the beginning of the
    next document, or all of them if there are fewer. Next is by doc_id, equal ids by a hash of the text, rows without an id
    last; the last row's next is the first, and a single row's is itself. Likeness is the share of paragraph digests that both
    have among those that either has, counted by what peeling finds; ``cells_*`` say how large the sketch had to be. Null
    texts are empty, two empty texts are alike, repeated rows are rows, no rows give none.

    Rows are dealt to ranges of (doc_id, hash) and read in order, a slice at a time; where ranges meet, only each range's
    first and last row travel.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    out = f"doc_id long, {_RESULT}"
    with_ends = f"kind int, task int, text string, {out}"
    done = written(rows.mapInArrow(_in_order(_arrow(with_ends)), with_ends), "fingerprints", "zstd")
    # one row a range: which range comes next, the first after the last
    heads = done.where("kind = 1").select("task", "text")
    tasks = heads.select("task").withColumn("after", F.coalesce(F.lead("task").over(Window.orderBy("task")), F.min("task").over(Window.partitionBy())))
    tails = done.where("kind = 2").select("task", "doc_id", "text").join(tasks, "task")
    ends = tails.join(heads.select(F.col("task").alias("after"), F.col("text").alias("next_text")), "after").select("doc_id", "text", "next_text")
    return done.where("kind = 0").select(*_arrow(out).names).unionAll(ends.mapInArrow(_pairs(_arrow(out)), out))


def changed_paragraphs(versions: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``versions`` with the digests that only ``old`` has (``gone``), those that only ``new`` has (``come``), and their likeness (``near``).

    One row each, in its place; texts are compared within their row, null being empty.
    """
    small_batches(versions.sparkSession)
    spot = [versions.columns.index(c) for c in (old, new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[t.as_py() or b"" for t in batch.column(k).cast(pa.binary())] for k in spot]
            for a, b in _slices(sides[0], 0):
                n = b - a
                key, first = digests(*_flat(sides[0][a:b] + sides[1][a:b]))
                _, pair, digest, side = differences(key, first, np.arange(n), np.arange(n, 2 * n))
                size = np.diff(first)
                near = likeness(size[:n], size[n:], np.bincount(pair, minlength=n))
                lists = []
                for s in (1, -1):
                    mine = np.flatnonzero(side == s)
                    mine = mine[np.lexsort((digest[mine].view(np.int64), pair[mine]))]
                    lists.append(pa.ListArray.from_arrays(np.searchsorted(pair[mine], np.arange(n + 1)).astype(np.int32), pa.array(digest[mine].view(np.int64))))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, n).columns, *lists, pa.array(near)], [*batch.schema.names, "gone", "come", "near"])
        release()

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in versions.schema)
    return versions.mapInArrow(run, f"{columns}, gone array<bigint>, come array<bigint>, near double")
