"""Tickers of a whole market found in texts by their aliases, between word borders and whatever the case.

While all aliases together are small they are one Aho-Corasick automaton, and a text is read once for all of them. Word
borders need no check of each hit: texts and aliases carry a mark at each border, so that an alias only fits between two.
With larger sets, the runs of words of each text that may be names are found where the text is; they meet the names in groups of documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property, partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.shared import cut, small_batches

#: Letters of all aliases up to which the automaton is sent to all workers; each takes some 50 bytes there.
LETTERS = 2_000_000
_MARK = "\0"
_BORDER = re.compile(r"\b")


def marked(text: str) -> str:
    """Lower-case ``text`` with a mark at each border of a word."""
    return _BORDER.sub(_MARK, text.lower().replace(_MARK, "\1"))


class Automaton:
    """Names to find, each with the places of its tickers; built once in each worker."""

    def __init__(self, names: Sequence[tuple[str, int]], tickers: Sequence[str]):
        self.names, self.tickers = names, tickers

    @cached_property
    def _built(self) -> ahocorasick.Automaton:
        places: dict[str, list[int]] = {}
        for name, place in self.names:
            places.setdefault(f"{_MARK}{marked(name).strip(_MARK)}{_MARK}", []).append(place)
        built = ahocorasick.Automaton()
        for key, found in places.items():
            built.add_word(key, tuple(found))
        built.make_automaton()
        return built

    def find(self, text: str | None) -> list[str]:
        """Tickers of the aliases in ``text``, in the order of the names."""
        if not text or not self.names:
            return []
        places = {found for _, found in self._built.iter(marked(text))}
        return [self.tickers[p] for p in sorted({p for found in places for p in found})]


def alias_names(aliases: DataFrame) -> DataFrame:
    """(ord, ticker, name) of ``aliases`` (ord, ticker, alias): a name for each alias and each ticker itself; blank ones are left out."""
    both = aliases.select("ord", "ticker", F.explode(F.array("alias", "ticker")).alias("alias"))
    return both.select("ord", "ticker", F.lower(F.trim("alias")).alias("name")).where("name <> ''").distinct()


def find_aliases(docs: DataFrame, aliases: DataFrame, text: str = "text", into: str = "tickers", letters: int = LETTERS) -> DataFrame:
    """``docs`` with ``into``: the tickers with a name in the text, each once, by ``ord``.

    ``aliases`` are rows (ord, ticker, alias); a ticker has one ord. Null texts have none.
    """
    names = cut(alias_names(aliases))
    if _letters(names) <= letters:
        return _by_automaton(docs, names, text, into)
    return _by_spans(docs, names, text, partial(_with_tickers, into), [T.StructField(into, T.ArrayType(T.StringType()))])


def _letters(names: DataFrame) -> int:
    return names.agg(F.sum(F.length("name"))).first()[0] or 0


def _by_automaton(docs: DataFrame, names: DataFrame, text: str, into: str) -> DataFrame:
    """By one automaton, whose letters were counted; it isn't part of the plan."""
    rows = names.orderBy("ord", "ticker", "name").collect()
    tickers = list(dict.fromkeys((r["ord"], r["ticker"]) for r in rows))
    place = {t: n for n, t in enumerate(tickers)}
    shared = docs.sparkSession.sparkContext.broadcast(Automaton([(r["name"], place[r["ord"], r["ticker"]]) for r in rows], [t for _, t in tickers]))

    @F.pandas_udf("array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(shared.value.find, na_action=None)

    return docs.withColumn(into, find(F.col(text)))


#: Bytes of texts whose tokens are made at a time.
_BYTES = 1 << 20


@cache
def _word_characters() -> np.ndarray:
    """For each code point whether it is a word character, as in Python's patterns."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


@cache
def _hashing() -> tuple[np.ndarray, int, int]:
    """A number for each byte, and an odd base and its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    return np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64), base, pow(base, -1, 1 << 64)


class _Tokens:
    """The bytes of texts as runs of word characters and of others, which never go beyond a text."""

    def __init__(self, texts: pa.StringArray):
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.texts = at.astype(np.int64) - at[0]
        word = self._words()
        new = np.concatenate([word[:1] == word[:1], word[1:] != word[:-1]])
        new[self.texts[self.texts < len(self.data)]] = True
        self.begin = np.flatnonzero(new)
        self.end = np.concatenate([self.begin[1:], [len(self.data)]])[: len(self.begin)]
        self.word = word[self.begin]
        #: The first token of each text, and behind the last.
        self.first = np.searchsorted(self.begin, self.texts)
        self.of = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def _words(self) -> np.ndarray:
        """For each byte whether its character is one of a word."""
        word = _word_characters()[:256][self.data] & (self.data < 128)
        high = np.flatnonzero(self.data >= 128)
        lead = self.data[high] >= 0xC0
        if lead.any():
            at = high[lead]
            b = [self.data[np.minimum(at + k, len(self.data) - 1)].astype(np.int64) for k in range(4)]
            two, three, four = ((b[0] & 31) << 6) | (b[1] & 63), ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63), ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63)
            code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four))
            word[high] = _word_characters()[np.minimum(code, 0x10FFFF)][np.maximum(np.cumsum(lead) - 1, 0)]
        return word

    def hashes(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Hashes of the bytes from some places to others: differences of one running total."""
        numbers, base, inverse = _hashing()
        power, back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(self.data), x, np.uint64)])) for x in (base, inverse))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers[self.data] * power[:-1], dtype=np.uint64)])

        def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            h = (total[end] - total[begin]) * back[begin]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(32))

        return of

    def runs(self, n: int) -> np.ndarray:
        """First tokens of all runs of n tokens of a text; one that begins or ends outside a word needs a word beyond."""
        i = np.arange(max(0, len(self.begin) - n + 1))
        low, high = self.first[self.of[i]], self.first[self.of[i] + 1]
        return i[(i + n <= high) & (self.word[i] | (i > low)) & (self.word[i + n - 1] | (i + n < high))]

    def strings(self, begin: np.ndarray, end: np.ndarray) -> pa.StringArray:
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
        return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def _pieces(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """Texts by the megabyte; a longer one alone."""
    texts = texts.fill_null("")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, int)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, _BYTES + (sizes[at - 1] if at else 0), "right")))
        yield texts.slice(at, end - at)
        at = end


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words of lower-case texts, and "" for names without any."""
    for batch in batches:
        for texts in _pieces(batch.column(0)):
            tokens = _Tokens(texts)
            words = tokens.strings(tokens.begin[tokens.word], tokens.end[tokens.word]).unique()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([""])])], ["__word"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names with their first word ("": none), how many tokens they are, and their hash."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        at = 0
        for names in _pieces(batch["name"]):
            tokens = _Tokens(names)
            count = np.diff(tokens.first)
            words, where = np.flatnonzero(tokens.word), np.zeros(len(names), int) - 1
            where[tokens.of[words[::-1]]] = words[::-1]
            begin, end = (np.where(where < 0, 0, x[where]) for x in (tokens.begin, tokens.end))
            made = [tokens.strings(begin, end), pa.array(count.astype(np.int32)), pa.array(tokens.hashes()(tokens.texts[:-1], tokens.texts[1:]).view(np.int64))]
            part = rows.slice(at, len(names)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "__word", "__n", "__hash"])
            at += len(names)


def _bitmap(hashes: DataFrame, most: int = 1 << 28) -> np.ndarray:
    """A bit for each ``__hash``, some 16 bits a name and ``most`` at most (32 MB), so that most runs of words that are no name needn't be kept."""
    size = min(most, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
    at = F.pmod(F.col("__hash"), F.lit(size)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for part in parts:
        begin = (part["n"] - 1) * (1 << 12)
        bits[begin : begin + (1 << 12)] = np.frombuffer(part["bits"], np.uint8)
    return bits


def _likely(texts: pa.StringArray, bits: np.ndarray, sizes: Sequence[int]) -> pa.ListArray:
    """For each lower-case text its different runs of as many tokens as names have, and whose hash has a bit."""
    made = [_likely_of(_Tokens(part), bits, sizes) for part in _pieces(texts)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.string()))


def _likely_of(tokens: _Tokens, bits: np.ndarray, sizes: Sequence[int]) -> pa.ListArray:
    hashed, found = tokens.hashes(), []
    for n in sizes:
        i = tokens.runs(n)
        begin, end = tokens.begin[i], tokens.end[i + n - 1]
        h = hashed(begin, end)
        at = (h & np.uint64(bits.size * 8 - 1)).astype(np.int64)
        known = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        found.append((tokens.of[i[known]], begin[known], end[known], h[known]))
    of, begin, end, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 4
    once = np.flatnonzero(~pd.Series(h.astype(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).duplicated().to_numpy())
    once = once[np.argsort(of[once], kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of[once], minlength=len(tokens.texts) - 1))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens.strings(begin[once], end[once]))


def _by_spans(docs: DataFrame, names: DataFrame, text: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[T.StructField]) -> DataFrame:
    """By the runs of words of each text that are likely names; ``make`` adds ``fields`` to groups of documents behind their names.

    Documents go to two groups a core, each behind the table of all names whose first word is in some document. So names meet
    documents by equality where the document is, and neither pairs of document and name nor those of document and ticker are shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = docs.select(F.lower(text)).mapInArrow(_words, "__word string").distinct()
    facts = names.mapInArrow(_facts, T.StructType([*names.schema.fields, *T._parse_datatype_string("__word string, __n int, __hash long").fields]))
    names = cut(facts.join(words, "__word", "left_semi").select("ord", "ticker", "name", "__n", "__hash"))
    sizes = [r[0] for r in names.select("__n").distinct().orderBy("__n").collect()]  # lengths in tokens, a handful
    bits = spark.sparkContext.broadcast(_bitmap(names.select("__hash").distinct()))
    likely = F.arrow_udf(lambda texts: _likely(texts, bits.value, sizes), "array<string>")
    groups = 2 * spark.sparkContext.defaultParallelism
    group = F.pmod(F.xxhash64(*docs.columns[:1], text), F.lit(groups)).cast("int")
    # names go as packed batches, in order over the whole table
    packed = names.select("ord", "ticker", "name").repartitionByRange("ord").sortWithinPartitions("ord", "ticker").mapInArrow(_packed, "__packed binary").withColumn("__place", F.monotonically_increasing_id())
    known = packed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("__group"), F.lit(0).alias("__kind"), "__place", "__packed")
    rows = docs.select(group.alias("__group"), F.lit(1).alias("__kind"), F.struct(*docs.columns).alias("__row"), likely(F.lower(F.coalesce(text, F.lit("")))).alias("__names"))
    both = known.unionByName(rows, allowMissingColumns=True).repartitionById(groups, F.col("__group")).sortWithinPartitions("__kind", "__place")
    return both.mapInArrow(lambda batches: make(_unpacked(batches)), T.StructType([*docs.schema.fields, *fields]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["__packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names and documents of a group, a row each."""
    for batch in batches:
        packs = int((batch["__kind"].to_numpy() == 0).sum())  # before documents
        for row in range(packs):
            for names in pa.ipc.open_stream(batch["__packed"][row].as_buffer()):
                group, kind = (pa.array(np.full(names.num_rows, x, np.int32)) for x in (batch["__group"][row].as_py(), 0))
                yield pa.RecordBatch.from_arrays([group, kind, *names.columns], ["__group", "__kind", *names.schema.names])
        if packs < batch.num_rows:
            yield batch.slice(packs).select(["__group", "__kind", "__names", "__row"])


#: Tickers of a batch of documents.
_TICKERS = 500_000
#: Places of tickers that are put together at a time, and tickers of a range, which processors keep near while documents pass.
_PLACES, _RANGE = 2_000_000, 1 << 16


def _with_tickers(into: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the tickers of their names."""
    for table, part in _grouped(batches):
        yield from table.joined(part, into)


def _with_digests(given: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the count and digest of their tickers, those that are ``given`` first."""
    for table, part in _grouped(batches):
        yield from table.digested(part, given)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Places, pa.RecordBatch]]:
    """Rows of documents, each with the names of their group, which come before them by ord and ticker."""
    group, read, table = None, [], None
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            of, kind = batch["__group"][at].as_py(), batch["__kind"][at].as_py()
            same = (batch["__group"].to_numpy()[at:] == of) & (batch["__kind"].to_numpy()[at:] == kind)
            part = batch.slice(at, len(same) if same.all() else int(same.argmin()))
            at += part.num_rows
            if of != group:
                group, read, table = of, [], None
            if kind == 0:
                read.append(part.select(["ord", "ticker", "name"]))
                continue
            table = table or _Places(read)
            yield table, part


class _Places:
    """The tickers of a group in their order, and where those of each name are."""

    def __init__(self, read: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(read).combine_chunks() if read else pa.table({"ord": pa.array([], pa.int64()), "ticker": pa.array([], pa.string()), "name": pa.array([], pa.string())})
        read.clear()  # what was read isn't held twice
        same = lambda c: pc.equal(rows[c][1:], rows[c][:-1]).to_numpy() if rows.num_rows else np.zeros(0, bool)
        new = np.concatenate([np.ones(min(1, rows.num_rows), bool), ~(same("ord") & same("ticker"))])
        self.tickers = pa.concat_arrays(rows["ticker"].filter(pa.array(new)).chunks or [pa.array([], pa.string())])
        codes = rows["name"].combine_chunks().dictionary_encode() if rows.num_rows else pa.array([], pa.string()).dictionary_encode()
        codes = pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes
        del rows
        self.code, codes = {name: n for n, name in enumerate(codes.dictionary.to_pylist())}, codes.indices.to_numpy()
        self.places = (np.cumsum(new, dtype=np.int32) - np.int32(1))[np.argsort(codes, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.code)))]).astype(np.int64)
        self.known: dict[str, int | None] = {}

    def found(self, part: pa.RecordBatch) -> Iterator[np.ndarray]:
        """For each document the places of its tickers, in order; runs of words that are no name have none."""
        held = part["__names"]
        counts = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
        flat = held.flatten().dictionary_encode()
        codes = np.array([self.code.get(name, -1) for name in flat.dictionary.to_pylist()], np.int64)[flat.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
        for first, last in zip(ends[:-1], ends[1:], strict=True):
            of = codes[first:last]
            of = of[of >= 0]
            begin, size = self.ends[of], self.ends[of + 1] - self.ends[of]
            behind = np.cumsum(size)
            places = np.sort(self.places[np.repeat(begin - behind + size, size) + np.arange(size.sum())])
            once = np.ones(len(places), bool)
            np.not_equal(places[1:], places[:-1], out=once[1:])
            yield places if once.all() else places[once]

    def joined(self, part: pa.RecordBatch, into: str) -> Iterator[pa.RecordBatch]:
        lists, size, first = [], 0, 0
        for n, places in enumerate(self.found(part)):
            lists.append(places)
            size += len(places)
            if size >= _TICKERS or n == part.num_rows - 1:
                ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                tickers = pa.ListArray.from_arrays(ends, self.tickers.take(pa.array(np.concatenate(lists))))
                rows = part["__row"].slice(first, n + 1 - first)
                columns = [*rows.flatten(), tickers]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in rows.type), into])
                lists, size, first = [], 0, n + 1

    def digested(self, part: pa.RecordBatch, given: str) -> Iterator[pa.RecordBatch]:
        columns = {f.name: c for f, c in zip(part["__row"].type, part["__row"].flatten(), strict=True)}
        before = columns[given].to_pylist()
        self._know({t for x in before for t in x or ()})
        made, lists, size = [], [], 0
        for n, places in enumerate(self.found(part)):
            first = list(dict.fromkeys(before[n] or ()))
            known = [self.known[t] for t in first if self.known[t] is not None]
            places = places[~np.isin(places, known)] if known else places
            lists.append((first, places))
            size += len(places)
            if size >= _PLACES or n == part.num_rows - 1:
                made += zip([len(f) + len(p) for f, p in lists], self._digests(lists), strict=True)
                lists, size = [], 0
        counts, digests = zip(*made, strict=True)
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], [*columns, "n", "tickers_md5"])

    def _know(self, given: set[str]) -> None:
        """Looks up where given tickers are, each once."""
        new = sorted(given - self.known.keys())
        if new:
            self.known |= dict(zip(new, pc.index_in(pa.array(new), self.tickers).to_pylist(), strict=True))

    @cached_property
    def _ranges(self) -> list[pa.Array]:
        """Tickers behind commas, range by range; where all are as long, without offsets, so that they are taken faster."""
        out = []
        for at in range(0, len(self.tickers), _RANGE):
            part = pc.binary_join_element_wise(",", self.tickers.slice(at, _RANGE), "").cast(pa.binary())
            sizes = pc.unique(pc.binary_length(part))
            out.append(part.cast(pa.binary(sizes[0].as_py())) if len(sizes) == 1 else part)
        return out

    def _digests(self, lists: list[tuple[list[str], np.ndarray]]) -> list[str]:
        """MD5 of all tickers between commas. All documents go through a range before the next is begun."""
        made = [hashlib.md5(",".join(first).encode()) for first, _ in lists]
        begun = [bool(first) for first, _ in lists]
        borders = np.arange(0, len(self.tickers) + _RANGE, _RANGE)
        cuts = [np.searchsorted(places, borders).tolist() for _, places in lists]
        for k, tickers in enumerate(self._ranges):
            parts = [places[c[k] : c[k + 1]] for (_, places), c in zip(lists, cuts, strict=True)]
            counts = np.cumsum([0, *map(len, parts)])
            if not counts[-1]:
                continue
            taken = tickers.take(pa.array(np.concatenate(parts) - np.int32(k * _RANGE)))
            if pa.types.is_fixed_size_binary(taken.type):
                data, ends = memoryview(taken.buffers()[1]), counts * taken.type.byte_width
            else:
                data, ends = memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[counts]
            ends = ends.tolist()
            for n, (begin, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if end > begin:
                    made[n].update(data[begin if begun[n] else begin + 1 : end])
                    begun[n] = True
        return [m.hexdigest() for m in made]


def _given(explicit: Column) -> Column:
    """Explicit tickers as they count: trimmed, blank ones left out."""
    return F.filter(F.transform(F.coalesce(explicit, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: F.coalesce(t != "", F.lit(False)))


def link_digests(docs: DataFrame, aliases: DataFrame, explicit: Column | None = None, text: str = "text", letters: int = LETTERS) -> DataFrame:
    """``docs`` with ``n`` and ``tickers_md5``: how many tickers link_documents() gives, and the MD5 of them between commas.

    Of many names, lists that are a share of a whole market for each document don't leave the task that puts them together.
    """
    names = cut(alias_names(aliases))
    given = F.array().cast("array<string>") if explicit is None else _given(explicit)
    if _letters(names) <= letters:
        out = docs.withColumn("__tickers", given)
        out = _by_automaton(out, names, text, "__matched").withColumn("__tickers", F.array_distinct(F.concat("__tickers", "__matched")))
        return out.withColumns({"n": F.size("__tickers").cast("long"), "tickers_md5": F.md5(F.concat_ws(",", "__tickers").cast("binary"))}).drop("__tickers", "__matched")
    fields = [T.StructField("n", T.LongType()), T.StructField("tickers_md5", T.StringType())]
    return _by_spans(docs.withColumn("__given", given), names, text, partial(_with_digests, "__given"), fields).drop("__given")


def link_documents(docs: DataFrame, aliases: DataFrame, explicit: Column | None = None, text: str = "text", into: str = "tickers", letters: int = LETTERS) -> DataFrame:
    """``docs`` with ``into``: the explicit tickers as given (trimmed where unknown, blank ones left out), then those found, each once."""
    out = find_aliases(docs, aliases, text, "__matched", letters)
    if explicit is None:
        return out.withColumnRenamed("__matched", into)
    return out.withColumn(into, F.array_distinct(F.concat(_given(explicit), "__matched"))).drop("__matched")
