import random
import zlib

import numpy as np
import pytest
from helpers import awkward, documents, nothing

from tickloom.llm import language


def greedy(text, sample):
    """Phrases of a greedy parse into longest matches, letter by letter."""
    count, i = 0, 0
    while i < len(text):
        size = 0
        while i + size < len(text) and text[i : i + size + 1] in sample:
            size += 1
        i += max(size, 1)
        count += 1
    return count


def test_phrases_equal_a_search_in_the_text():
    rng = random.Random(2)
    make = lambda n, alphabet: "".join(rng.choice(alphabet) for _ in range(n))
    samples = (("x", make(300, "abc ").encode()), ("y", make(300, "bcd ").encode()))
    texts = [make(rng.randrange(0, 200), "abcd e") for _ in range(40)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = language.phrases(data, offsets, samples)
    # a phrase ends where the match breaks: the last one of a text isn't counted unless it breaks
    for row, text in zip(got, texts, strict=True):
        for k, (_, sample) in enumerate(samples):
            assert abs(int(row[k]) - greedy(text, sample.decode())) <= 1


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    rows = language.language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.95 and len(rows) > 1000
    assert rows["score"].between(0, 1).all() and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"])


def test_held_out_languages_are_not_learned(spark):
    docs = documents(spark)
    ids = docs.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0")
    rest = docs.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) <> 0")
    changed = rest.unionByName(ids.selectExpr("doc_id", "text", "'zz' AS lang", "source", "n_chars"))
    assert language.learn(docs) == language.learn(changed)


@pytest.fixture(scope="module")
def learned(spark):
    return language.learn(documents(spark))


def test_awkward_documents(spark, learned):
    out = language.identify(awkward(spark), learned).collect()
    by = [(r["doc_id"], r["lang_pred"], r["score"]) for r in out]
    assert len(by) == 14 and {i for i, p, _ in by if p == "und"} == {1, 2, 3, 10, None}
    assert all(s == 0 for _, p, s in by if p == "und") and all(0 < s <= 1 for _, p, s in by if p != "und")
    assert all(p in {n for n, _ in learned} | {"und"} for _, p, _ in by)


def test_nothing_learned_and_no_rows(spark, learned):
    assert {r["lang_pred"] for r in language.language_id(awkward(spark).drop("lang").selectExpr("*", "cast(null AS string) AS lang")).collect()} == {"und"}
    assert language.language_id(nothing(spark)).count() == 0 and language.identify(nothing(spark), learned).count() == 0


def test_phrases_are_normalised_by_the_length_of_the_sample(spark):
    rng = random.Random(8)
    make = lambda n, weights: "".join(rng.choices("abcd", weights, k=n))
    much, little = (1, 1, 1, 1), (12, 4, 3, 1)
    samples = (("little", make(300, little).encode()), ("much", make(30_000, much).encode()))
    rows = [(n, make(400, little if n % 2 else much)) for n in range(60)]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()
    right = sum(r["lang_pred"] == ("little" if r["doc_id"] % 2 else "much") for r in out)
    print(f"{right} of 60 right")
    assert right == 60 and all(0.5 <= r["score"] <= 1 for r in out)


def test_languages_without_letters_change_nothing(spark, learned):
    """Samples that are empty, blank or a letter or two long never win, nor do rows labelled so."""
    docs = documents(spark)
    want = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, learned).collect()}
    for odd in (b"", b" ", b"a", b"ab", b"e n"):
        assert {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, tuple(sorted([*learned, ("aa", odd), ("zz", odd)]))).collect()} == want
    digits = spark.createDataFrame([(10_000 + k, "12345 67890", "xx", "s", 11) for k in range(11)], docs.schema)
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_id(docs.unionByName(digits)).collect() if r["doc_id"] < 10_000}
    assert got == {r["doc_id"]: r["lang_pred"] for r in language.language_id(docs).collect()}


def test_samples_of_many_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 5)
    monkeypatch.setattr(language, "ALL_LETTERS", 600)
    rows = [(n, f"letters of a language {'abcdefghij'[n % 9] * 8} " * 20, f"l{n % 9}") for n in range(90)] + [(99, "more of it " * 30, "l3")]
    samples = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), None)
    assert len(samples) == 5 and samples[-1][0] == "l4" and all(len(s) == 120 for _, s in samples)
