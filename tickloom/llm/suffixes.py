"""Repeated-substring removal by a common-prefix-aware distributed merge of sorted suffix runs.

Every ``SPAN``-byte window has an anchor: the place in it whose ``KMER`` bytes hash lowest. Equal windows have equal
anchors, so only suffixes that begin at anchors need sorting, and only those whose anchor another document has as well. A block
of documents sends these suffixes to hash buckets as sorted, front-coded runs; a bucket merges its runs with a loser
tree that keeps the common prefix of every loser with the last winner and never compares those bytes again. Suffixes that
share an anchor are neighbours then, their windows are compared, and every block learns which of its windows begin in a
smaller document too. An anchor that very many suffixes share is no bucket of its own: each of its suffixes is cut to parts
of its windows, and a part goes to the bucket of the bytes that all windows of the part hold.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textblocks as tb
from tickloom.llm.common import parts_for, small_batches
from tickloom.llm.lm import HASH_BITS, bucket_of, dealt_to_blocks, filled, pack, small, unpack, unsmall

SPAN, KMER = 50, 20
#: Text of a block; a task needs some 25 times as much while it sorts.
BLOCK_BYTES = 8 << 20
#: Suffixes of one anchor whose windows are looked up one by one; those of more are compared in columns.
FEW = 128
_LEFT = SPAN - KMER
#: An anchor of more suffixes (equal ones of a block counted once) is split into parts of its windows: (fewest, most bytes before the anchor).
HEAVY, PARTS = 2048, ((0, 7), (8, 15), (16, 23), (24, _LEFT))
_NO_ID = np.iinfo(np.int64).max

_ANCHORS = "block long, bucket long, number long, hashes binary, several binary, counts binary"
_SHARED = "block long, bucket long, number long, mask binary, heavy binary"
_RUN = "block long, bucket long, number long, prefix binary, size binary, rest binary, left_size binary, left binary, docs binary"
_REMOVED = "block long, bucket long, number long, windows binary"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in ddl.split(", ")])


class Block:
    """The anchors of a block of texts: place, first and last window, document, hash, and hash of all windows of each."""

    def __init__(self, table: pa.Table, buckets: int):
        column = table["text"]
        self.data, self.offsets = tb.utf8(column)
        ids = table["doc_id"].cast(pa.int64())
        self.ids = np.asarray(ids.fill_null(_NO_ID))
        self.buckets = buckets
        found: list[list[np.ndarray]] = [[] for _ in range(6)]
        row, n = 0, len(self.offsets) - 1
        while row < n:
            end = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + tb.SLICE_BYTES, "right")) - 1)
            for kept, x in zip(found, self._anchors(row, end), strict=True):
                kept.append(x)
            row = end
        self.at, self.first, self.last, self.doc, self.hash, self.span = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        self.hash = self.hash.astype(np.uint64)
        self.bucket = bucket_of(self.hash, buckets)

    def _anchors(self, row: int, end: int) -> Iterator[np.ndarray]:
        base = int(self.offsets[row])
        data, offsets = self.data[base : self.offsets[end]], self.offsets[row : end + 1] - base
        if len(data) < SPAN:
            return (np.zeros(0, np.int64) for _ in range(6))
        prefix = tb.prefix_hash(data)
        down = tb.powers(len(prefix))[1]
        hashes = tb.mixed((prefix[KMER:] - prefix[:-KMER]) * down[: len(data) - KMER + 1])
        key = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        low, width = key, 1
        while width * 2 <= _LEFT + 1:
            low, width = np.minimum(low[:-width], low[width:]), width * 2
        extra = _LEFT + 1 - width
        low = np.minimum(low[: len(low) - extra], low[extra:]) if extra else low
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that begins in each place
        length = np.diff(offsets)
        doc = np.repeat(np.arange(len(length)), np.maximum(length - SPAN + 1, 0))
        start = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(length - SPAN + 1, 0)) - np.maximum(length - SPAN + 1, 0), np.maximum(length - SPAN + 1, 0)) + offsets[:-1][doc]
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(start)) - 1 if len(begin) else begin
        s, e = start[begin], start[stop]
        span = ((prefix[e + SPAN] - prefix[s]) * down[s]).view(np.int64)
        return (x for x in (anchor[begin] + base, s + base, e + base, doc[begin] + row, (hashes[anchor[begin]] >> np.uint64(64 - HASH_BITS)).astype(np.int64), span))

    def anchors(self, block: int) -> list[dict]:
        """Distinct anchor hashes by bucket, which of them several documents of the block have, and how many different suffixes each has."""
        distinct, place = np.unique(self.hash, return_inverse=True)
        order = np.lexsort((self.span, place))
        new = np.ones(len(order), bool)
        new[1:] = (place[order][1:] != place[order][:-1]) | (self.span[order][1:] != self.span[order][:-1])
        count = np.bincount(place[order][new], minlength=len(distinct))
        low, high = np.full(len(distinct), _NO_ID), np.full(len(distinct), -_NO_ID - 1)
        np.minimum.at(low, place, self.ids[self.doc])
        np.maximum.at(high, place, self.ids[self.doc])
        return [{"block": block, "bucket": b, "number": e - s, "hashes": pack(distinct[s:e]), "several": np.packbits(low[s:e] < high[s:e]).tobytes(), "counts": small(count[s:e])} for b, (s, e) in filled(bucket_of(distinct, self.buckets)).items()]

    def suffixes(self, shared: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The shared suffixes and the parts of heavy ones, sorted by bucket, bytes from the anchor on, bytes before it, and document.

        Returns (number of the anchor, is it the first of equals, number of its class, bytes and sizes (rows of 96), bucket).
        """
        distinct, place = np.unique(self.hash, return_inverse=True)
        edge = filled(bucket_of(distinct, self.buckets))
        common, heavy = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for r in shared:
            for flags, sent in ((common, r["mask"]), (heavy, r["heavy"])):
                flags[slice(*edge[r["bucket"]])] = np.unpackbits(np.frombuffer(sent, np.uint8), count=r["number"])
        some = np.flatnonzero(common[place]) if len(place) else np.zeros(0, np.int64)
        split = heavy[place[some]] if len(some) else np.zeros(0, bool)
        whole, split = some[~split], some[split]
        # all windows of a part hold its fewest bytes before the anchor, and behind it what its most leave of SPAN
        parts = [split[(self.at[split] - self.first[split] >= lo) & (self.last[split] - self.at[split] >= -hi)] for lo, hi in PARTS]
        some = np.concatenate([whole, *parts])
        lo, hi = (np.repeat([x, *(p[k] for p in PARTS)], [len(whole), *map(len, parts)]) for k, x in ((0, 0), (1, _LEFT)))
        at = self.at[some]
        right, left = np.minimum(self.last[some] + SPAN - at, SPAN - lo), np.minimum(at - self.first[some], hi)
        rows = np.zeros((len(some), 96), np.uint8)
        for k in range(SPAN):
            there = k < right
            rows[there, k] = self.data[at[there] + k]
        for k in range(_LEFT):
            there = k < left
            rows[there, 56 + k] = self.data[at[there] - 1 - k]
        rows[:, 88], rows[:, 89] = right, left
        bucket = self.bucket[some]
        start = len(whole)
        for (fewest, most), part in zip(PARTS, parts, strict=True):
            held = rows[start : start + len(part)].copy()
            held[:, SPAN - most : 56] = 0
            held[:, 56 + fewest :] = 0
            total = tb.mixed(held.view(np.uint64) @ tb.powers(13)[0][1:] + np.uint64(fewest))
            bucket[start : start + len(part)] = ((total >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
            start += len(part)
        words = rows.view(">u8")
        order = np.lexsort((self.ids[self.doc[some]], *(words[:, k] for k in range(11, -1, -1)), bucket))
        some, rows, bucket = some[order], rows[order], bucket[order]
        words = rows.view(">u8")
        first = np.ones(len(some), bool)
        first[1:] = (words[1:] != words[:-1]).any(1) | (bucket[1:] != bucket[:-1])
        return some, first, np.cumsum(first) - 1, rows, bucket

    def runs(self, block: int, shared: list[dict]) -> list[dict]:
        """A front-coded run of distinct suffixes for each bucket: the prefix shared with the one before, and the rest."""
        some, first, _, rows, bucket = self.suffixes(shared)
        some, rows, bucket = some[first], rows[first], bucket[first]
        right, left = rows[:, 88].astype(np.int64), rows[:, 89].astype(np.int64)
        prefix = np.zeros(len(some), np.int64)
        if len(some) > 1:
            differ = rows[1:, :SPAN] != rows[:-1, :SPAN]
            prefix[1:] = np.where(differ.any(1), differ.argmax(1), SPAN)
            prefix[1:] = np.minimum(prefix[1:], np.minimum(right[1:], right[:-1]))
        edge = filled(bucket)
        prefix[[s for s, _ in edge.values()]] = 0
        place = np.arange(SPAN)
        out = []
        for b, (s, e) in edge.items():
            rest = rows[s:e, :SPAN][(place >= prefix[s:e, None]) & (place < right[s:e, None])]
            before = rows[s:e, 56 : 56 + _LEFT][np.arange(_LEFT) < left[s:e, None]]
            out.append({"block": block, "bucket": b, "number": e - s, "prefix": prefix[s:e].astype(np.uint8).tobytes(), "size": right[s:e].astype(np.uint8).tobytes(), "rest": rest.tobytes(), "left_size": left[s:e].astype(np.uint8).tobytes(), "left": before.tobytes(), "docs": small(self.ids[self.doc[some[s:e]]])})
        return out

    def covered(self, shared: list[dict], removed: list[dict]) -> np.ndarray:
        """Which bytes lie in a window that also begins in a smaller document."""
        some, first, number, rows, bucket = self.suffixes(shared)
        heads = np.flatnonzero(first)
        edge = filled(bucket[heads])
        answer = np.zeros(len(heads), np.uint32)
        for r in removed:
            answer[slice(*edge[r["bucket"]])] = np.frombuffer(r["windows"], np.uint32)
        # Equal suffixes of larger documents of the block go whole; those of the least document as answered.
        least = self.ids[self.doc[some[heads]]][number] if len(heads) else np.zeros(0, np.int64)
        mask = np.where(self.ids[self.doc[some]] > least, np.uint32(0xFFFFFFFF), answer[number] if len(heads) else np.zeros(0, np.uint32))
        begins = np.zeros(len(self.data) + 1, np.int32)
        for back in range(_LEFT + 1):
            hit = ((mask >> np.uint32(back)) & np.uint32(1)).astype(bool) & (rows[:, 88] >= SPAN - back) & (rows[:, 89] >= back)
            begins[self.at[some[hit]] - back] = 1
        so_far = np.cumsum(begins[:-1], dtype=np.int32)
        gone = so_far > 0
        gone[SPAN:] = so_far[SPAN:] > so_far[:-SPAN]
        return gone


class Run:
    """A front-coded run, decoded as it is read."""

    def __init__(self, row: dict):
        self.prefix, self.rest = row["prefix"], row["rest"]
        self.size, self.left_size, self.left = row["size"], row["left_size"], row["left"]
        self.docs = array("q", unsmall(row["docs"]).tobytes())
        self.number, self.next, self.from_rest, self.head = row["number"], 0, 0, b""

    def advance(self) -> int:
        """Moves to the next suffix; its common prefix with the one before, -1 at the end."""
        if self.next == self.number:
            return -1
        shared = self.prefix[self.next]
        taken = self.size[self.next] - shared
        self.head = self.head[:shared] + self.rest[self.from_rest : self.from_rest + taken]
        self.from_rest += taken
        self.next += 1
        return shared


def _differ(a: bytes, b: bytes, start: int) -> int:
    """The first place from ``start`` on where a and b differ, or the end of the shorter."""
    end = min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    return start


def merged(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(common prefix with the one before, run, number in the run) of all suffixes in sorted order.

    A loser tree: each inner node holds the run that lost there and the length of its common prefix with the run that
    won, which is what it shares with the suffix put out last. Of two with different lengths the longer is smaller;
    bytes are only compared behind an equal length, so no byte is compared twice.
    """
    size = 1
    while size < len(runs):
        size *= 2
    shared = [run.advance() for run in runs] + [-1] * (size - len(runs))
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's common prefix becomes that with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].head, runs[b].head
        at = _differ(s, t, x)
        if at == len(s) or (at < len(t) and s[at] < t[at]):
            shared[b] = at
            return a, b
        shared[a] = at
        return b, a

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while shared[top] >= 0:
        yield shared[top], top, runs[top].next - 1
        shared[top] = runs[top].advance()
        node = (top + size) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def _earlier(classes: dict[tuple[bytes, bytes], int]) -> list[int]:
    """For each class of suffixes with one anchor the windows (a bit each, by bytes before the anchor) that a smaller document has too.

    Windows of FEW classes are looked up one by one. Of more they are rows of bytes: for each place of the anchor equal
    rows are found by sorting their hashes, by sorting the rows themselves if two that differ have one hash.
    """
    if len(classes) <= FEW:
        least: dict[bytes, int] = {}
        windows = [[(back, x[:back][::-1] + r[: SPAN - back]) for back in range(SPAN - len(r), len(x) + 1)] for r, x in classes]
        for own, doc in zip(windows, classes.values(), strict=True):
            for _, window in own:
                least[window] = min(doc, least.get(window, doc))
        return [sum(1 << back for back, window in own if least[window] < doc) for own, doc in zip(windows, classes.values(), strict=True)]
    docs = np.array(list(classes.values()), np.int64)
    right, left = np.zeros((len(classes), SPAN), np.uint8), np.zeros((len(classes), _LEFT), np.uint8)
    for k, (r, x) in enumerate(classes):
        right[k, : len(r)] = np.frombuffer(r, np.uint8)
        left[k, : len(x)] = np.frombuffer(x, np.uint8)
    after, before = (np.array([len(c[k]) for c in classes]) for k in (0, 1))
    out = np.zeros(len(classes), np.uint32)
    for back in range(_LEFT + 1):
        some = np.flatnonzero((back >= SPAN - after) & (back <= before))
        if len(some) < 2:
            continue
        rows = np.zeros((len(some), 56), np.uint8)
        rows[:, :back] = left[some, :back][:, ::-1]
        rows[:, back:SPAN] = right[some, : SPAN - back]
        words = rows.view(np.uint64)
        total = tb.mixed(words @ tb.powers(8)[0][1:])
        order = np.argsort(total, kind="stable")
        total = total[order]
        new = np.concatenate([[True], (words[order][1:] != words[order][:-1]).any(1)])
        if (new[1:] & (total[1:] == total[:-1])).any():
            order = np.lexsort(words.T)
            new = np.concatenate([[True], (words[order][1:] != words[order][:-1]).any(1)])
        least = np.minimum.reduceat(docs[some][order], np.flatnonzero(new))
        hit = least[np.cumsum(new) - 1] < docs[some][order]
        out[some[order[hit]]] |= np.uint32(1 << back)
    return out.tolist()


def _windows(group: list[tuple[int, bytes, bytes, int, int]], out: list[array]) -> None:
    """Marks the windows of a group of suffixes with one anchor: (run, bytes from it on, bytes before it, document, number)."""
    classes: dict[tuple[bytes, bytes], int] = {}
    for _, right, left, doc, _ in group:
        key = (right, left)
        classes[key] = min(doc, classes.get(key, doc))
    marked = dict(zip(classes, _earlier(classes), strict=True)) if len(classes) > 1 else {}
    for run, right, left, doc, number in group:
        if doc > classes[right, left]:
            out[run][number] = 0xFFFFFFFF
        elif marked:
            out[run][number] = marked[right, left]


def _merge_runs(sent: list[dict]) -> list[dict]:
    """The windows of every suffix of the runs of a bucket that begin in a smaller document too. Numbers are kept in arrays, not lists."""
    runs = [Run(r) for r in sent]
    out = [array("I", bytes(4 * r["number"])) for r in sent]
    left_at = [array("q", np.cumsum(np.frombuffer(b"\0" + r["left_size"], np.uint8), dtype=np.int64).tobytes()) for r in sent]
    group: list[tuple[int, bytes, bytes, int, int]] = []
    for shared, k, n in merged(runs):
        if shared < KMER:
            if len(group) > 1:
                _windows(group, out)
            group = []
        run = runs[k]
        group.append((k, run.head, run.left[left_at[k][n] : left_at[k][n + 1]], run.docs[n], n))
    if len(group) > 1:
        _windows(group, out)
    return [{k: r[k] for k in ("block", "bucket", "number")} | {"windows": w.tobytes()} for r, w in zip(sent, out, strict=True)]


def _running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place; a block has fewer than 2 ** 31 bytes."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document, kept being its remaining bytes.

    A byte goes if a 50-byte string that covers it also begins in a document with a smaller doc_id, judged on the UTF-8
    bytes of the input (null: none); matches never cross documents. Of exact copies the smallest doc_id keeps its bytes.
    Texts under 50 bytes keep all. Rows with one doc_id don't count as smaller than each other; null ids count as larger
    than all. Bytes may be cut inside a character. Ids are integers of any width; an empty table gives no rows, and further
    columns play no part.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = parts_for(docs.sparkSession, size, BLOCK_BYTES)
    dealt = dealt_to_blocks(rows, n_blocks)
    anchors_schema, shared_schema, run_schema, removed_schema = map(_schema, (_ANCHORS, _SHARED, _RUN, _REMOVED))
    if not isinstance(rows.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be an integer: documents are ordered by it")
    rest_schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def number(table: pa.Table) -> int:
        return table["block"][0].as_py()

    def send_anchors(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(Block(table, n_blocks).anchors(number(table)), anchors_schema)
        tb.release()
        return out

    def find_shared(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        hashes = [unpack(r["hashes"]) for r in sent]
        _, place, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        several = count > 1
        several[place[np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=r["number"]) for r in sent]).astype(bool)]] = True
        heavy = np.bincount(place, np.concatenate([unsmall(r["counts"]) for r in sent])) > HEAVY
        end = np.cumsum([len(h) for h in hashes])
        flags = lambda told, h, e: np.packbits(told[place[e - len(h) : e]]).tobytes()
        return pa.Table.from_pylist([{k: r[k] for k in ("block", "bucket", "number")} | {"mask": flags(several, h, e), "heavy": flags(heavy, h, e)} for r, h, e in zip(sent, hashes, end, strict=True)], shared_schema)

    def send_runs(table: pa.Table, shared: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(Block(table, n_blocks).runs(number(table), shared.to_pylist()) if table.num_rows else [], run_schema)
        tb.release()
        return out

    def merge_runs(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(_merge_runs(table.to_pylist()), removed_schema)
        tb.release()
        return out

    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        out_schema = pa.schema([table.schema.field("doc_id"), *rest_schema])
        if not table.num_rows:
            return out_schema.empty_table()
        block, told = Block(table, n_blocks), answers.to_pylist()
        gone = block.covered([r for r in told if r["mask"] is not None], [r for r in told if r["windows"] is not None])
        offsets = block.offsets
        before = _running(gone)
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(gone)]
        starts[edge] = gone[edge]
        spans = _running(starts)
        kept_offsets = offsets - before[offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(kept_offsets.astype(np.int64).tobytes()), pa.py_buffer(block.data[~gone].tobytes())]).cast(pa.binary())
        out = pa.Table.from_arrays([table["doc_id"].combine_chunks(), pa.array(np.diff(offsets)), *(pa.array(np.diff(x[offsets]).astype(np.int64)) for x in (before, spans)), kept], schema=out_schema)
        del block, told, gone, before, starts, spans
        tb.release()
        return out

    shared = dealt.groupBy("block").applyInArrow(send_anchors, _ANCHORS).groupBy("bucket").applyInArrow(find_shared, _SHARED)
    runs = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_runs, _RUN)
    removed = runs.groupBy("bucket").applyInArrow(merge_runs, _REMOVED)
    answers = shared.withColumn("windows", F.lit(None).cast("binary")).unionByName(removed, allowMissingColumns=True)
    kind = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut_out, kind)
