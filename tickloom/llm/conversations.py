"""Conversation structure repair: the cheapest edits that make roles alternate, by a forward Viterbi search.

The grammar ``(s?(ua)+)?`` over role initials has four states: nothing yet, after the system turn, after a user turn,
after an assistant turn. The search carries, for each state, the least (cost, edits as a string) over all rows so far;
between rows come at most two inserts, as a third would come back to a state already reached. Strings aren't kept: two
that have used up the same rows and end in the last one never begin alike to the end of one of them, so that their order
is a rank of four, and each row keeps where its states came from. Costs are kept as differences, which stay few, so each
step is looked up.

A conversation may be most of the table. Rows are dealt to ranges of (conversation, order); each range gives its part of
a conversation as a 4 x 4 table from state to state, and the tables of a conversation are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, only, small_batches, written

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bytes of repaired text that go on as one row where a conversation spans ranges.
PART_BYTES, OUT_ROWS = 1 << 20, 1000
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
#: From each state the states that inserts reach: (how many, which). A user comes next unless a user came last.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_REACH = [[(j, s) for j, s in enumerate(chain) if s not in chain[:j]] for chain in ([s, _NEXT[s], _NEXT[_NEXT[s]]] for s in range(4))]
#: A row is of kind 0 if it must go, else 1 + 2 * initial + truncated.
_INITIALS = "sua"

_Back = tuple[tuple[int, str] | None, ...]


def kind_of(initial: str, truncated: bool, must_go: bool) -> int:
    place = _INITIALS.find(initial) if initial else -1
    return 0 if must_go else 1 + 2 * (place if place >= 0 else 3) + truncated


@lru_cache(1 << 16)
def _step(costs: tuple, ranks: tuple, kind: int) -> tuple[tuple, tuple, int, _Back]:
    """One row: costs above the least and ranks of the four states after it, by how much the least rose, and whence each came."""
    best: list = [None] * 4
    for state in range(4):
        if costs[state] is None:
            continue
        for j, at in _REACH[state]:
            cost = costs[state] + j * INSERT
            moves = [(at, "D", cost + DELETE)]
            if kind:
                initial, truncated = divmod(kind - 1, 2)
                cost += TRUNCATED * truncated
                moves.append((_NEXT[at], "R", cost + REROLE))
                kept = initial + 1
                if kept == _NEXT[at] or (kept == SYSTEM and at == START):
                    moves.append((kept, "K", cost))
            for to, edit, total in moves:
                found = (total, ranks[state], "I" * j + edit, state)
                if best[to] is None or found < best[to]:
                    best[to] = found
    least = min(b[0] for b in best if b)
    order = sorted((b[1:3], s) for s, b in enumerate(best) if b)
    ranks = [0] * 4
    for rank, (_, s) in enumerate(order):
        ranks[s] = rank
    return tuple(b and b[0] - least for b in best), tuple(ranks), least, tuple(b and (b[3], b[2]) for b in best)


def search(rows: Sequence[tuple[int, int]], entry: int) -> list[tuple[int, int, str] | None]:
    """For each state after ``rows`` (kind, copies): (cost, rank, edits) from ``entry``. Copies beyond the first must go."""
    costs: tuple = tuple(0 if s == entry else None for s in range(4))
    ranks, total = (0, 0, 0, 0), 0
    backs: list[tuple[_Back, int]] = []
    for kind, copies in rows:
        left = copies
        while left:
            new, order, rise, back = _step(costs, ranks, kind if left == copies else 0)
            settled = new == costs and order == ranks and all(b is None or b == (s, "D") for s, b in enumerate(back))
            times = left if settled and (left < copies or kind == 0) else 1
            backs.append((back, times))
            total += rise * times
            costs, ranks, left = new, order, left - times
    out: list = [None] * 4
    for state in range(4):
        if costs[state] is None:
            continue
        parts, at = [], state
        for back, times in reversed(backs):
            at, edits = back[at]
            parts.append(edits * times)
        out[state] = (total + costs[state], ranks[state], "".join(reversed(parts)))
    return out


def closing(ends: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """(state, cost, inserts) of the cheapest end, given each state's (cost, rank)."""
    cost, _, inserts, state = min((cost + j * INSERT, rank, "I" * j, state) for state, (cost, rank) in ends.items() for j, at in _REACH[state] if at in (START, ASSISTANT))
    return state, cost, inserts


def illegal_pairs(initials: Sequence[str], copies: Sequence[int]) -> int:
    """Neighbours whose initials aren't su, ua or au; copies stand side by side."""
    return sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])) + sum(copies) - len(copies)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut short, repeated or given to the user, by crc32 of ``conv_id:turn``.

    Nulls count as one space, but the id and turn stay null in the result.
    """
    rows = only(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(filled("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


def _key(conv_id: str = "conv_id") -> Column:
    """A text that stands for the id and is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[list, bool]]:
    """Neighbouring rows with equal values in the first ``by`` columns, as lists of tuples, and whether they are the first."""
    rows, key, first = [], None, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[:by] != key:
                yield rows, first
                rows, first = [], False
            key = row[:by]
            rows.append(row)
    if rows:
        yield rows, first


_PIECE = "key string, piece long, at long, costs array<bigint>, ranks array<int>, edits array<string>, illegal long, head string, tail string"
_PATH = "key string, piece long, entry int, leave int, inserts string, whole boolean, cost long, illegal long"
_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def _batched(ddl: str):
    """Makes record batches of a generator's rows, of OUT_ROWS rows or about PART_BYTES of text."""
    schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in ddl.split(", ")])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def decorate(rows_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, size = [], 0
            for size_of, row in rows_of(batches):
                waiting.append(row)
                size += size_of
                if len(waiting) >= OUT_ROWS or size > PART_BYTES:
                    yield made(waiting)
                    waiting, size = [], 0
            if waiting:
                yield made(waiting)

        return run

    return decorate


@_batched(_PIECE)
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """Sorted rows (piece, key, at, kind, copies, initial) to a table from state to state for each conversation in the piece.

    Only a piece's first conversation can have begun before it; all others are searched from the start alone.
    """
    last = None
    for rows, _ in _groups(batches, 2):
        piece, key, at = rows[0][:3]
        entries = range(4) if piece != last else (START,)
        last = piece
        costs, ranks, edits = ([None] * 16 for _ in range(3))
        for entry in entries:
            for state, end in enumerate(search([r[3:5] for r in rows], entry)):
                if end:
                    costs[4 * entry + state], ranks[4 * entry + state], edits[4 * entry + state] = end
        size = sum(len(e) for e in edits if e)
        yield size, (key, piece, at, costs, ranks, edits, illegal_pairs([r[5] for r in rows], [r[4] for r in rows]), rows[0][5], rows[-1][5])


@_batched(_PATH)
def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """A conversation's pieces (key, piece, costs, ranks, illegal, head, tail) in order to the states between them."""
    for rows, _ in _groups(batches, 1):
        ends, backs, illegal, tail = {START: (0, 0)}, [], 0, None
        for _, _, costs, ranks, bad, head, end in rows:
            found = {}
            for to in range(4):
                ways = [(cost + costs[4 * s + to], rank, ranks[4 * s + to], s) for s, (cost, rank) in ends.items() if costs[4 * s + to] is not None]
                if ways:
                    found[to] = min(ways)
            order = sorted(found, key=lambda s: found[s][1:3])
            ends = {s: (found[s][0], order.index(s)) for s in found}
            backs.append({s: found[s][3] for s in found})
            illegal += bad + (tail is not None and tail + head not in _LEGAL)
            tail = end
        state, cost, inserts = closing(ends)
        final = True
        for row, back in zip(reversed(rows), reversed(backs), strict=True):
            yield 0, (row[0], row[1], back[state], state, inserts if final else "", len(rows) == 1, cost if final else None, illegal if final else None)
            state, final = back[state], False


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows (at, flag, piece, key, role, text, copies, edits, entry, whole), headers before rows, to (key, piece, whole, role, text) and, after each header's rows, one without a role."""
    head, edits, spot, state = None, "", 0, START

    def inserts():
        nonlocal spot, state
        while spot < len(edits) and edits[spot] == "I":
            state, spot = _NEXT[state], spot + 1
            yield *head, "user" if state == USER else "assistant", ""

    for batch in batches:
        for _, flag, piece, key, role, text, copies, given, entry, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if flag == 0:
                if head:
                    yield from inserts()
                    yield *head, None, None
                head, edits, spot, state = (key, piece, whole), given, 0, entry
                continue
            for _ in range(copies):
                yield from inserts()
                edit, spot = edits[spot], spot + 1
                if edit == "K":
                    state = _INITIALS.index(role[0]) + 1
                    yield *head, role, text
                elif edit == "R":
                    state = _NEXT[state]
                    yield *head, "user" if state == USER else "assistant", text
    if head:
        yield from inserts()
        yield *head, None, None


_DIGEST = "key string, piece long, number long, part binary, repaired_sha256 string"
_ROW = "key string, piece long, number long, role string, text string"


@_batched(_DIGEST)
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """Conversations that lie within their range to digests; the text of others in parts, each row after a line break."""
    hashed, waiting, number = hashlib.sha256(), bytearray(), 0
    for key, piece, whole, role, text in _repaired(batches):
        if role is not None:
            waiting += f"\n{role}:{text}".encode()
        if role is None or len(waiting) > PART_BYTES:
            if whole:
                hashed.update(waiting[1:] if number == 0 else waiting)
            elif waiting:
                yield len(waiting), (key, piece, number, bytes(waiting), None)
            waiting, number = bytearray(), number + 1
        if role is None:
            if whole:
                yield 0, (key, piece, None, None, hashed.hexdigest())
            hashed, number = hashlib.sha256(), 0


@_batched("key string, repaired_sha256 string")
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """Sorted parts (key, piece, number, part) to one digest a conversation; only one part is held."""
    now, hashed = None, None
    for batch in batches:
        for key, _, _, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != now:
                if hashed:
                    yield 0, (now, hashed.hexdigest())
                now, hashed, part = key, hashlib.sha256(), part[1:]
            hashed.update(part)
    if hashed:
        yield 0, (now, hashed.hexdigest())


@_batched(_ROW)
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
    """The repaired rows themselves, numbered within their range."""
    for number, (key, piece, _, role, text) in enumerate(_repaired(batches)):
        if role is not None:
            yield len(text), (key, piece, number, role, text)


@dataclass
class Repair:
    """The repair of conversations (conv_id, turn, role, text; rows as they stand, repeated ones too).

    Order: turn, nulls first, then role, then a hash of the text; equal rows stand side by side. A row's initial is its
    role's first character; a role without one fits nowhere. A row is blank (nothing but ASCII white space), else a
    duplicate (same role and text earlier), else truncated (doesn't end in one of .!?), else sound. Null roles, texts are empty.
    """

    conversations: DataFrame

    @property
    def _tasks(self) -> int:
        """As many as there are ranges, and not joined because rows are narrow: the work isn't."""
        return int(self.conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def rows(self) -> DataFrame:
        """Equal rows once with their number, in order, written: ``at`` grows with the order, its upper bits are the range.

        Equal rows are counted before they are dealt, so copies aren't one task; what is left differs within each range's
        order, so ``at`` doesn't depend on how rows arrive.
        """
        small_batches(self.conversations.sparkSession)
        rows = only(self.conversations, conv_id="conv_id", turn="turn", role="role", text="text")
        rows = rows.select(_key().alias("key"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        rows = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64("text"))
        order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("at", F.monotonically_increasing_id())
        return written(rows.drop("hash").withColumn("piece", F.shiftright("at", 33)), "conversations")

    @cached_property
    def faults(self) -> DataFrame:
        """A narrow row for each of ``rows``: its first fault, its kind in the search, its initial."""
        end = F.rtrim("text", F.lit(_SPACE))
        same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
        rows = self.rows.select("key", "piece", "at", "turn", "copies", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), same.alias("same"))
        first = rows.where("NOT blank").groupBy("key", "same").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
        rows = rows.drop("same").join(first, "at", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        kind = F.lit(7)
        for k, initial in enumerate(_INITIALS):
            kind = F.when(F.col("initial") == initial, 1 + 2 * k).otherwise(kind)
        return cut(rows.withColumn("kind", F.when(F.col("first"), kind + F.col("open").cast("int")).otherwise(0)))

    @cached_property
    def _tables(self) -> DataFrame:
        pieces = self.faults.select("piece", "key", "at", "kind", "copies", "initial").repartition(self._tasks, "piece").sortWithinPartitions("at")
        return written(pieces.mapInArrow(_pieces, _PIECE), "conversation-pieces")

    @cached_property
    def _chosen(self) -> DataFrame:
        narrow = self._tables.select("key", "piece", "costs", "ranks", "illegal", "head", "tail").repartition(self._tasks, "key").sortWithinPartitions("key", "piece")
        paths = narrow.mapInArrow(_paths, _PATH)
        tables = self._tables.select("key", "piece", "at", F.col("edits").alias("all"))
        edits = F.concat(F.element_at("all", F.col("entry") * 4 + F.col("leave") + 1), F.col("inserts"))
        return written(paths.join(tables, ["key", "piece"]).select("key", "piece", "at", "entry", "whole", "cost", "illegal", edits.alias("edits")), "conversation-edits")

    def report(self) -> DataFrame:
        """One row a conversation: ``key`` (see _key()), gaps, blank, duplicate, truncated, illegal, cost, audit."""
        count = lambda c: F.sum(c).cast("long")
        n = F.col("copies")
        duplicate = F.when(F.col("blank"), 0).when(F.col("first"), n - 1).otherwise(n)
        truncated = (F.col("first") & F.col("open")).cast("long")
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
        facts = self.faults.groupBy("key").agg(gaps.alias("gaps"), count(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), count(duplicate).alias("duplicate"), count(truncated).alias("truncated"))
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "edits"))), lambda x: x["edits"]), "")
        edits = self._chosen.groupBy("key").agg(count("illegal").alias("illegal"), count("cost").alias("cost"), audit.alias("audit"))
        return facts.join(edits, "key")

    def _stream(self) -> DataFrame:
        rows = self.rows.select("at", F.lit(1).alias("flag"), "piece", "key", "role", "text", "copies", F.lit(None).cast("string").alias("edits"), F.lit(None).cast("int").alias("entry"), F.lit(None).cast("boolean").alias("whole"))
        none = F.lit(None).cast("string")
        heads = self._chosen.select("at", F.lit(0), "piece", "key", none, none, F.lit(None).cast("long"), "edits", "entry", "whole")
        return rows.unionAll(heads).repartition(self._tasks, "piece").sortWithinPartitions("at", "flag")

    def repaired(self) -> DataFrame:
        """The repaired rows: key, role, text, in the order of (piece, number)."""
        return self._stream().mapInArrow(_rows, _ROW)

    def digests(self) -> DataFrame:
        """(key, repaired_sha256) of the repaired rows ``role:text``, joined by line breaks.

        A digest takes its bytes one after the other, so a conversation that spans ranges sends them, already repaired, to
        the one task that hashes it, which holds one part at a time.
        """
        done = written(self._stream().mapInArrow(_digests, _DIGEST), "conversation-digests")
        parts = done.where("part IS NOT NULL").select("key", "piece", "number", "part").repartition(self._tasks, "key").sortWithinPartitions("key", "piece", "number")
        return done.where("repaired_sha256 IS NOT NULL").select("key", "repaired_sha256").unionAll(parts.mapInArrow(_joined, "key string, repaired_sha256 string"))


def repair_report(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired text for every conv_id of ``originals``, given its ``rows``.

    A conversation without rows, or with none left, has an empty text; one without rows also zeros and an empty audit. A
    null id is a conversation, turns that are all null leave no gaps, an empty table gives no rows.
    """
    repair = Repair(rows)
    report = repair.report().join(repair.digests(), "key", "left")
    ids = originals.select(F.col("conv_id")).distinct().withColumn("key", _key())
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")
    return ids.join(report, "key", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), digest)
