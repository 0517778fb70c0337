import math
from collections import Counter

import duckdb
import pytest
from helpers import SF, awkward, nothing, texts_of, words

from tickloom.llm import lm, queries


def brute(texts, order=3, backoff=0.4):
    """[(words, backed off, score)] by counting the n-grams of all other texts in dictionaries."""
    split = [words(t) for t in texts]
    count = {n: Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1)) for n in range(1, order + 1)}
    total = max(sum(map(len, split)), 1)
    out = []
    for w in split:
        score, backed = 0.0, 0
        own = Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
        others = lambda gram: count[len(gram)][gram] - own[gram]  # noqa: B023, E731
        for i in range(len(w)):
            longest = min(i + 1, order)
            n = longest
            while n > 1 and not others(tuple(w[i - n + 1 : i + 1])):
                n -= 1
            gram = tuple(w[i - n + 1 : i + 1])
            found = (others(gram), others(gram[:-1])) if n > 1 else (max(others(gram), 1), max(total - len(w), 1))
            score += math.log(found[0] / found[1]) + (longest - n) * math.log(backoff)
            backed += n < longest
        out.append((len(w), backed, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_dictionaries(spark, order):
    docs = awkward(spark)
    rows = texts_of(docs)
    want = sorted(((i, *x[:2], round(x[2], 6)) for (i, _), x in zip(rows, brute([t for _, t in rows], order), strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["n_words"], r["n_backed_off"], round(r["log_score"], 6) + 0.0) for r in lm.score_documents(docs, order=order).collect()), key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-5)


def test_equals_sql(spark):
    got = queries.op3_stupid_backoff(spark, SF).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(lm.ORACLE).df().sort_values("doc_id")
    assert got[["doc_id", "n_words", "n_backed_off"]].values.tolist() == want[["doc_id", "n_words", "n_backed_off"]].values.tolist()
    assert got["log_score"].tolist() == pytest.approx(want["log_score"].tolist(), abs=2e-4)


def test_empty_table(spark):
    assert lm.score_documents(nothing(spark)).count() == 0


@pytest.mark.parametrize("limit", [1_000, 3])
def test_copies_of_a_row_over_a_shuffled_input(spark, monkeypatch, limit):
    """Copies of a row vouch for each other; dealt by content, or beyond a limit by number too, with the same scores."""
    monkeypatch.setattr(lm, "COPIES", limit)
    rows = [(7, "one two three four")] * 40 + [(None, "one two"), (8, "five six"), (9, "two three four nine nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "text").withColumn("block", lm.F.lit(1))
    want = sorted((i is not None, i or 0, x[:2], round(x[2], 6)) for (i, _), x in zip(rows, brute([t for _, t in rows]), strict=True))
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, (r["n_words"], r["n_backed_off"]), round(r["log_score"], 6) + 0.0) for r in lm.score_documents(docs).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-5)
    assert (lm.dealt_to_blocks(docs.select("doc_id", "text"), 64).where("doc_id = 7").select("block").distinct().count() > 1) == (limit == 3)


def test_buckets_without_entries_are_not_walked(spark):
    """A block has as many rows to send as it has buckets with n-grams, and the same n-grams however many buckets there are."""
    texts = lm.pa.array([f"w{i % 50} w{i % 7} w{i}" for i in range(300)])
    hashes = {}
    for buckets in (4, 10**9):
        block = lm.Block(texts, 2, buckets)
        sent = block.send(2, 0, None)
        assert len(sent) <= min(buckets, len(block.distinct[2]))
        assert [r["bucket"] for r in sent] == sorted({r["bucket"] for r in sent})
        hashes[buckets] = lm.np.concatenate([lm.unpack(r["hashes"]) for r in sent]).tolist()
        answers = [r | {"mask": lm.np.packbits(lm.np.ones(r["number"], bool)).tobytes(), "totals": r["counts"]} for r in sent]
        own = lm.np.bincount(block.place[2], minlength=len(block.distinct[2]))[block.place[2]] - block.own(2)
        assert block.elsewhere(2, answers, None).tolist() == own.tolist()
    assert hashes[4] == hashes[10**9] == block.distinct[2].tolist()
