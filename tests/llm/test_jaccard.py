import random

import pytest
from helpers import awkward, documents, groups, nothing, texts_of, words

from tickloom.llm import jaccard


def shingles(text):
    w = words(text)
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """(doc_id, links, class) of rows with distinct ids, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    links = []
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links.append((i, j))
    part = groups([i for i, _ in rows], links)
    number = dict.fromkeys(part, 0)
    for pair in links:
        for i in pair:
            number[i] += 1
    return sorted((i, number[i], part[i]) for i in part)


def got(df):
    return sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in df.collect())


def test_equals_all_pairs(spark):
    docs = documents(spark)
    out = jaccard.links(docs)
    assert got(out) == brute(texts_of(docs))
    assert out.where("kept").count() == out.select("class_id").distinct().count()


@pytest.fixture(scope="module")
def planted():
    """A large group of near copies around one text, chains, and copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows = []
    for n in range(150):
        w = list(base)
        w[rng.randrange(120)] = word()
        rows.append((n, " ".join(w)))
    chain = [word() for _ in range(100)]
    for n in range(150, 160):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((n, " ".join(chain)))
    rows += [(n, " ".join(base)) for n in range(160, 200)]
    rows += [(n, " ".join(word() for _ in range(rng.randrange(1, 60)))) for n in range(200, 300)]
    return rows


def test_planted_groups(spark, planted):
    assert got(jaccard.links(spark.createDataFrame(planted, "doc_id long, text string"))) == brute(planted)


def test_awkward_documents(spark):
    out = jaccard.links(awkward(spark))
    rows = out.collect()
    assert len(rows) == 14
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_links"], r["class_id"], r["kept"]))
    assert by[0] == [(1, 0, True)] and by[6] == [(1, 0, False)] and by[5] == [(1, 4, False)] and by[8] == [(1, 7, False)]
    assert [by[k] for k in (1, 2, 3)] == [[(0, k, True)] for k in (1, 2, 3)]
    assert sorted(by[9]) == [(1, 9, False), (1, 9, True)] and sorted(by[None], key=repr) == [(0, None, True)] * 2


def test_distinct_documents(spark):
    docs = awkward(spark)
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[:10]) for r in kept.collect()), key=repr) == sorted([(0, "one two th"), (1, ""), (2, ""), (3, "   \n\t "), (4, "The same l"), (7, "short"), (9, "ünï cödé t"), (None, "a row with"), (None, ""), (10, "12345 6789")], key=repr)


def test_empty_table(spark):
    assert jaccard.links(nothing(spark)).count() == 0 and jaccard.distinct_documents(nothing(spark)).count() == 0


def test_runs_reach_the_recall():
    assert jaccard.runs_for(0.99) < jaccard.runs_for(0.9999) < 100
