"""Aliases of a market: both ways against the regular expressions, one by one."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.operators import aliases, linker
from tickloom.plans import scale_queries

ROWS = "ord long, ticker string, alias string"


def by_regex(text, table):
    names = {}
    for order, ticker, alias in table:
        names.setdefault((order, ticker), {ticker}).add(alias)
    return [t for (_, t), found in sorted(names.items()) if any(n and n.strip() and re.search(rf"\b{re.escape(n.strip())}\b", text or "", re.IGNORECASE) for n in found)]


@pytest.mark.parametrize("letters", [aliases.LETTERS, 0])
def test_equals_regular_expressions(spark, letters):
    draw = random.Random(4)
    words = ["net", "Net", ".NET", "c++", "data", "set", "é", "über", "x_1", "a-b", "ann", "42"]
    table = [(0, "NET", "net"), (1, "DOT", ".net"), (2, "CPP", "c++"), (3, "DS", "data set"), (4, "DS2", " Data Set "), (5, "E", "é"), (6, "NONE", " "), (6, "NONE", None), (7, "X", "x_1"), (8, "AB", "a-b"), (9, "PP", "++"), (10, "SP", "set data set"), (11, "U", "ÜBER")]
    texts = ["".join(draw.choice(words) + draw.choice([" ", "", ".", "  ", " - ", "\n", "!"]) for _ in range(draw.randrange(12))) for _ in range(300)] + [None, "", "data\0set", "\0", "x c++x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = {r["n"]: r["tickers"] for r in aliases.find_aliases(docs, spark.createDataFrame(table, ROWS), letters=letters).collect()}
    assert got == {n: by_regex(x, table) for n, x in enumerate(texts)}


def test_both_ways_equal_the_query_of_the_small_map(spark):
    symbols = {"tickers": {"DATA": {"aliases": ["the", "ing of"]}, "Über": {"aliases": []}, "X": {"aliases": ["eau", "in the"]}}}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = linker.symbol_table(spark, symbols)
    want = {r["doc_id"]: r["t"] for r in docs.select("doc_id", linker.resolve_tickers(docs["text"], symbols).alias("t")).collect()}
    for letters in (aliases.LETTERS, 0):
        got = {r["doc_id"]: r["tickers"] for r in aliases.link_documents(docs, table, letters=letters).collect()}
        assert got == want and any(got.values())


def test_without_aliases_or_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "n int, text string")
    none = spark.createDataFrame([], ROWS)
    for letters in (10, -1):
        assert [r["tickers"] for r in aliases.find_aliases(docs, none, letters=letters).collect()] == [[], []]
        assert aliases.find_aliases(docs.limit(0), spark.createDataFrame([(1, "A", "b")], ROWS), letters=letters).count() == 0


def test_a_market_of_tickers(spark):
    """Both ways equal the SQL; the plan doesn't grow with the aliases."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n, tickers_md5 FROM ({scale_queries.SQL['link_market']})").fetchall())
    for letters in (aliases.LETTERS, 0):
        assert sorted(map(tuple, scale_queries.link_market(spark, SF, letters).collect())) == want
    assert scale_queries._aliases(spark, SF).count() > 900
    docs = spark.createDataFrame([(1, "a")], "n int, text string")
    sizes = [len(aliases.find_aliases(docs, spark.range(n).selectExpr("id AS ord", "'T' || id AS ticker", "'name ' || id AS alias"))._jdf.queryExecution().toString()) for n in (10, 5000)]
    assert abs(sizes[0] - sizes[1]) < 200


def test_tickers_of_a_market_are_not_shuffled(spark):
    """A document may hold names of a share of all tickers; these are put together where the document is, after the last exchange."""
    docs = spark.createDataFrame([(1, "a b")], "n int, text string")
    plan = aliases.find_aliases(docs, spark.createDataFrame([(1, "A", "b")], ROWS), letters=0)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("Exchange") and "collect_list" not in plan


def test_documents_meet_the_names_of_their_group(monkeypatch):
    """In batches of any size, also for groups without names, and documents without any."""
    monkeypatch.setattr(aliases, "_TICKERS", 2)
    rows = []
    for group in (3, 4, 5):
        rows += [{"__group": group, "__kind": 0, "ord": o, "ticker": f"T{o}", "name": n} for o in range(4) for n in ("x", "y") if group != 4 and (n == "x" or o == group - 3)]
        rows += [{"__group": group, "__kind": 1, "__names": names, "__row": {"n": group * 10 + i}} for i, names in enumerate([["x"], None, ["y"], ["x", "y"]]) if group != 4 or names is None]
    table = pa.Table.from_pylist(rows, pa.schema([("__group", pa.int32()), ("__kind", pa.int32()), ("ord", pa.int64()), ("ticker", pa.string()), ("name", pa.string()), ("__names", pa.list_(pa.string())), ("__row", pa.struct([("n", pa.int32())]))]))
    every = ["T0", "T1", "T2", "T3"]
    want = [(30, every), (31, []), (32, ["T0"]), (33, every), (41, []), (50, every), (51, []), (52, ["T2"]), (53, every)]
    for size in (1, 3, 100):
        got = [(r["n"], r["found"]) for b in aliases._with_tickers("found", iter(table.to_batches(size))) for r in b.to_pylist()]
        assert got == want


def test_digests_are_those_of_the_lists(spark):
    """Both ways, with given tickers that are found too, unknown or blank, and documents without any."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    given = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("D3_1"), F.lit(" OTHER "), F.lit(""), F.lit("D5_3"), F.lit("D3_1")))
    table = scale_queries._aliases(spark, SF)
    lists = aliases.link_documents(docs, table, given, letters=0).collect()
    want = sorted((r["doc_id"], len(r["tickers"]), hashlib.md5(",".join(r["tickers"]).encode()).hexdigest()) for r in lists)
    assert max(n for _, n, _ in want) > 10 and (-1, 2, hashlib.md5(b"x").hexdigest()) not in want
    for letters in (aliases.LETTERS, 0):
        assert sorted(map(tuple, aliases.link_digests(docs, table, given, letters=letters).drop("text").collect())) == want


def test_runs_of_words_are_neither_rows_nor_joined(spark):
    """They meet the names in the task of their document, behind one exchange that holds each document once."""
    docs = spark.createDataFrame([(1, "a b")], "n int, text string")
    plan = aliases.find_aliases(docs, spark.createDataFrame([(1, "A", "b")], ROWS), letters=0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("repartitionById") + plan.count("REPARTITION_BY_NUM") == 1


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_tokens_and_runs_of_any_characters(monkeypatch, most):
    """As Python's patterns have them, whatever texts are handled together."""
    monkeypatch.setattr(aliases, "_BYTES", most)
    draw = random.Random(9)
    parts = ["a", "bc", "é", "ß", "Ω", "中文", "٣", "_", " ", ".", "-", "\u0301", "😀", "𝔘", "\n", "\0", "½"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(200)] + ["", None]
    tokens = [re.findall(r"\w+|\W+", x or "") for x in texts]
    made = aliases._Tokens(pa.array(texts).fill_null(""))
    assert made.strings(made.begin, made.end).to_pylist() == [t for of in tokens for t in of] and made.of.tolist() == [n for n, of in enumerate(tokens) for _ in of]

    def runs(of, n):
        fits = lambda i: (re.match(r"\w", of[i]) or i) and (re.match(r"\w", of[i + n - 1]) or i + n < len(of))
        return {"".join(of[i : i + n]) for i in range(len(of) - n + 1) if fits(i)}

    every = np.full(1 << 12, 255, np.uint8)
    for sizes in ([1, 3], [2], []):
        got = aliases._likely(pa.chunked_array([pa.array(["x"] + texts)]).combine_chunks().slice(1) if most == 1 else pa.array(texts), every, sizes).to_pylist()
        assert [sorted(x) for x in got] == [sorted(set().union(*[runs(of, n) for n in sizes])) for of in tokens]


def test_digests_over_ranges_of_tickers(monkeypatch):
    """Whatever fits a range or a batch, with tickers of equal and of different lengths."""
    monkeypatch.setattr(aliases, "_RANGE", 4)
    monkeypatch.setattr(aliases, "_PLACES", 5)
    draw = random.Random(2)
    tickers = ["AA", "AB", "AC", "AD", "X", "LONGER", "é", "", "YY", "Z1", "Z2"]
    rows = [{"__group": 0, "__kind": 0, "ord": o, "ticker": t, "name": n} for o, t in enumerate(tickers) for n in "uvw" if draw.random() < 0.6]
    held = {n: {r["ord"] for r in rows if r["name"] == n} for n in "uvw"}
    docs = [(["u"], None), (["v", "none"], ["X", "Q"]), ([], ["Q"]), (None, []), (["u", "v", "w"], ["AA", "Z2", "AA"]), (["w", "u"], [])]
    schema = pa.schema([("__group", pa.int32()), ("__kind", pa.int32()), ("ord", pa.int64()), ("ticker", pa.string()), ("name", pa.string()), ("__names", pa.list_(pa.string())), ("__row", pa.struct([("n", pa.int32()), ("given", pa.list_(pa.string()))]))])
    table = pa.Table.from_pylist(rows + [{"__group": 0, "__kind": 1, "__names": names, "__row": {"n": n, "given": given}} for n, (names, given) in enumerate(docs)], schema)
    want = []
    for names, given in docs:
        first = list(dict.fromkeys(given or []))
        all_ = first + [tickers[o] for o in sorted(set().union(*[held.get(n, set()) for n in names or []])) if tickers[o] not in first]
        want.append((len(all_), hashlib.md5(",".join(all_).encode()).hexdigest()))
    for size in (1, 3, 100):
        got = [(r["n"], r["tickers_md5"]) for b in aliases._with_digests("given", iter(table.to_batches(size))) for r in b.select([1, 2, 3]).to_pylist()]
        assert got == want
