import math
import re

import pytest
from helpers import SF, awkward, documents, nothing

from tickloom.llm import decontaminate as d


def terms(text):
    """Letters and digits in runs; characters from U+0800 on one by one, but punctuation."""
    return re.findall(r"[\u0800-\u1fff\u2080-\u2fff\u3040-\ufeff\U00010000-\U0010ffff]|[0-9a-z\u0080-\u07ff]+", (text or "").lower())


def halves(text):
    """An item's terms as question and answer: whole last sentences of three terms, else the middle."""
    parts = [terms(x) for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])\s*", text.strip())]
    every = [t for x in parts for t in x]
    n = 0
    for k in range(len(parts) - 1, 0, -1):
        n += len(parts[k])
        if n >= 3 and len(every) - n >= 3:
            return every[:-n], every[-n:]
    return every[: len(every) // 2], every[len(every) // 2 :]


def held(side, doc):
    """The share of a side's runs of three terms (or of all its terms, if fewer) that a document has in one piece."""
    n = min(3, len(side))
    runs = {tuple(side[k : k + n]) for k in range(len(side) - n + 1)} if n else set()
    have = {tuple(doc[k : k + n]) for k in range(len(doc) - n + 1)}
    return len(runs & have) / len(runs) if runs else 1.0


def brute(docs, items):
    """{(doc, item): score} of all passages against all items, verified, without an index."""
    bags = [(i, terms(t)) for i, t in items if terms(t)]
    mean = sum(len(w) for _, w in bags) / len(bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    weigh = {}
    for i, w in bags:
        raw = {t: idf[t] * w.count(t) * (d.K1 + 1) / (w.count(t) + d.K1 * (1 - d.B + d.B * len(w) / mean)) for t in set(w)}
        own = sum(raw.values())
        weigh[i] = {t: x / own for t, x in raw.items()}
    passage = max(d.PASSAGE, 2 * max(len(w) for _, w in bags))
    sides = {i: [*halves(t or ""), terms(t)] for i, t in items}
    out = {}
    for doc, text in docs:
        w = terms(text)
        for shift in (0, passage // 2):
            cut = {}
            for k, t in enumerate(w):
                cut.setdefault((k + shift) // passage, set()).add(t)
            for bag in cut.values():
                for i, own in weigh.items():
                    score = sum(x for t, x in own.items() if t in bag)
                    if score < d.THRESHOLD - 1e-9:
                        continue
                    q, a, whole = (held(s, w) for s in sides[i])
                    if (q >= d.OVERLAP and a >= d.OVERLAP) or whole >= d.WHOLE:
                        out[doc, i] = max(score, out.get((doc, i), 0))
    return out


def test_equals_all_passages_against_all_items(spark):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.leaks(docs, bench).collect()}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert want
    kept = {r["doc_id"] for r in d.clean(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {i for i, _ in want}


ITEM = "Which river runs through the old city of Ambria and its seven quarters? It is the slow green Tessel."


def test_planted_items(spark):
    filler = "nothing to see here but plain words that carry on for a while and say little of note. "
    docs = spark.createDataFrame([(1, filler * 60 + ITEM + filler * 60), (2, ITEM.upper().replace(" ", "\n")), (3, filler * 10), (4, ITEM.split("?")[0]), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, ""), (10, ITEM), (11, "Other question entirely, about bees? Honey is made by them.")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in d.leaks(docs, bench).collect()) == [(1, 7), (1, 10), (2, 7), (2, 10)]
    assert sorted(r["doc_id"] for r in d.clean(docs, bench).collect()) == [3, 4, 5, 6]


def test_empty_tables_and_clashing_columns(spark):
    none, bench = spark.createDataFrame([], "item_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = awkward(spark)
    assert d.leaks(docs, none).count() == 0 and d.clean(docs, none).count() == 14 and d.leaks(nothing(spark), bench).count() == 0
    out = d.clean(docs, bench)
    assert out.columns == docs.columns and out.count() == 14


def test_search_in_several_indexes(spark, monkeypatch):
    docs, bench = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = sorted(map(tuple, d.leaks(docs, bench).collect()))
    monkeypatch.setattr(d, "INDEX_POSTINGS", 300)
    parts = sorted(map(tuple, d.leaks(docs, bench).collect()))
    assert [x[:2] for x in parts] == [x[:2] for x in whole] and [x[2] for x in parts] == pytest.approx([x[2] for x in whole])


def test_damaged_short_answer(spark):
    question = "Which river runs through the old city of Ambria and its seven quarters, past the mill, the tannery and the long stone bridge of the weavers?"
    item = question + " The green Tessel."
    docs = spark.createDataFrame([(1, item), (2, question), (3, question + " The green Tassel."), (4, " ".join(question.split()[:17])), (5, " ".join(question.split()[:17]) + " The green Tessel.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "Other question entirely, about bees? Honey is made by them.")], "item_id long, text string")
    found = {r["doc_id"]: (r["question_overlap"], r["answer_overlap"]) for r in d.leaks(docs, bench).collect()}
    assert found.keys() == {1, 2, 3, 5} and found[2] == found[3] == (1.0, 0.0)
    assert [r["doc_id"] for r in d.clean(docs, bench).collect()] == [4]


def test_short_and_unspaced_items(spark):
    items = [
        "What is the value of x in the equation of the four constants? x = 5",
        "Capital of France? Paris.",
        "中国的首都是哪里。答案是北京。",
        "เมืองหลวงของไทยคือกรุงเทพ",
        "Yes.",
    ]
    filler = "plain words that say little of note and carry on for a while, none of them in any test. "
    around = "这是一个很长的句子没有空格"
    texts = [x for item in items for x in (item, filler * 30 + item + " " + filler * 30, around + item + around)] + [filler * 10, around, "Paris, the capital of many things in France", "5 = x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute(list(enumerate(texts)), list(enumerate(items)))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.leaks(docs, bench).collect()}
    assert {(3 * i + k, i) for i in range(len(items)) for k in range(3)} <= got.keys()
    assert got.keys() == want.keys() and got == pytest.approx(want)
    assert not {doc for doc, _ in got} & set(range(15, 19))
