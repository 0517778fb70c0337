import base64
from collections import Counter

import public_tokenizers
import tiktoken
from helpers import LONG, SF, awkward, documents, nothing
from pyspark.sql import functions as F

from tickloom.llm import queries
from tickloom.llm.tokens import TokenRollup, with_tokens

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc_id long, source string, lang string, version string, tokens long")


def totals(rollup):
    return {(r["source"], r["lang"], r["version"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}


def test_counts_equal_the_tokenizer(spark):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame([(None, None), (10**6, ""), (10**6, "<|endoftext|>")], "doc_id long, text string"))
    code = plain()
    got = with_tokens(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert [r["tokens"] for r in got] == [len(code.encode_ordinary(r["text"])) if r["text"] is not None else 0 for r in got]


def test_deltas(spark, tmp_path):
    rollup = TokenRollup(spark, str(tmp_path))
    assert totals(rollup) == {}
    rollup.commit(1, changes(spark, [("insert", 1, "a", "en", "v", 10), ("insert", 2, "a", "en", "v", 20), ("insert", 2, "a", "en", "w", 7), ("insert", 3, None, None, "v", 5), ("insert", 3, None, None, "v", 5)]))
    assert totals(rollup) == {("a", "en", "v"): (2, 30), ("a", "en", "w"): (1, 7), (None, None, "v"): (2, 10)}
    second = changes(spark, [("delete", 1, None, None, "v", None), ("delete", 1, None, None, "v", None), ("revise", 2, "b", "de", "v", 21), ("delete", 99, "a", "en", "v", 1), ("odd", 2, "a", "en", "v", 1), ("revise", 3, "a", "en", "v", 6)])
    want = {("b", "de", "v"): (1, 21), ("a", "en", "w"): (1, 7), ("a", "en", "v"): (1, 6)}
    for _ in range(3):  # committing again changes nothing
        rollup.commit(2, second)
        assert totals(rollup) == want
    rollup.commit(3, changes(spark, []))
    assert totals(TokenRollup(spark, str(tmp_path))) == want
    rollup.commit(2, changes(spark, []))
    assert totals(rollup)[("a", "en", "v")] == (2, 30)


def test_query_equals_a_recount(spark):
    code, want = plain(), Counter()
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r["toxic"] == 1 or r["quality"] == 0:
            marks[r["doc_id"]] = max(r["toxic"], marks.get(r["doc_id"], 0))
    import re

    for r in documents(spark).collect():
        text = r["text"]
        if r["doc_id"] in marks:
            if marks[r["doc_id"]] == 1:
                continue
            text = re.sub(r"[ \t\n\x0b\f\r]+", " ", text)
        want[r["source"], r["lang"], "docs"] += 1
        want[r["source"], r["lang"], "tokens"] += len(code.encode_ordinary(text))
    got = Counter()
    for r in queries.op7_token_rollup(spark, SF).collect():
        got[r["source"], r["lang"], "docs"], got[r["source"], r["lang"], "tokens"] = r["docs"], r["tokens"]
    assert got == want


def test_clashing_names_long_texts_and_empty_tables(spark):
    code, docs = plain(), awkward(spark)
    for name in ("tokens", "revised", "text_0", "__text0"):
        docs = docs.withColumn(name, F.lit("x"))
    docs = docs.withColumn("spaced", F.upper("text"))
    got = with_tokens(docs, RANKS, public_tokenizers.PATTERN, {"tokens": "text", "revised": "spaced"}).collect()
    size = lambda t: len(code.encode_ordinary(t)) if t is not None else 0
    assert [(r["tokens"], r["revised"]) for r in got] == [(size(r["text"]), size(r["text"] and r["text"].upper())) for r in docs.collect()]
    assert {r["text_0"] for r in got} == {r["__text0"] for r in got} == {"x"} and max(r["tokens"] for r in got) == size(LONG)
    assert with_tokens(nothing(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_empty_documents(spark, tmp_path):
    nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.op7_token_rollup(spark, str(tmp_path)).count() == 0
