"""The index of pieces against a search of all texts."""

import random

import pytest

from tickloom.operators import events
from tickloom.operators.text_index import TextIndex

NODES = "id long, name string, text string"


def brute(nodes, words):
    texts = {i: (n if n is not None else x or "").lower() for i, n, x in nodes}
    return sorted((w, i) for w in {w.lower() for w in words if w is not None} for i, x in texts.items() if w in x)


def search(spark, index, words):
    return sorted(map(tuple, index.search(spark.createDataFrame([(w,) for w in words], "word string")).collect()))


def drawn(seed, n, first=0):
    draw = random.Random(seed)
    return [(first + i, draw.choice([None, "", "".join(draw.choice("abcä ") for _ in range(draw.randrange(30)))]), "".join(draw.choice("ABCD") for _ in range(draw.randrange(9)))) for i in range(n)]


def test_equals_a_search_of_all(spark, tmp_path):
    nodes, index = drawn(1, 300), TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(nodes, NODES))
    words = ["abc", "ABCA", "aa", "ä", "ca b", "zzz", "abcdabcd", "bä", "aaa", None, "", "abca", "a b c"]
    assert search(spark, index, words) == brute(nodes, words)


def test_replaced_and_added_nodes(spark, tmp_path):
    """A node counts as it was last added, and adding the same again changes nothing."""
    nodes, index = drawn(2, 200), TextIndex(spark, str(tmp_path / "i"))
    for part in (nodes, drawn(3, 50), drawn(4, 30, 500), drawn(4, 30, 500)):
        index.add(spark.createDataFrame(part, NODES))
    now = {**{n[0]: n for n in nodes}, **{n[0]: n for n in drawn(3, 50)}, **{n[0]: n for n in drawn(4, 30, 500)}}
    words = ["abc", "bca", "cdab", "b"]
    assert search(spark, index, words) == brute(now.values(), words)
    assert index.nodes().count() == 230


def test_candidates_are_few(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.range(2000).selectExpr("id", "concat('common part ', id) AS name", "null AS text"))
    words = spark.createDataFrame([("common part 1999",), ("part 77",)], "word string")
    assert index.candidates(words).count() < 200


def test_trigger_takes_an_index(spark, tmp_path):
    tags = spark.createDataFrame([(1, "ticker:A"), (1, "asof:2024-01-01"), (2, "ticker:B"), (2, "asof:2024-01-02")], "node_id long, tag string")
    nodes = spark.createDataFrame([(1, "Big Merger", None), (2, None, "no news")], NODES)
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(nodes)
    found = events.events_from_tags(tags)
    for match in ({"entityAny": ["MERGER", "x"]}, {"keywordAny": ["no"]}, {"entityAny": ["merger"], "keywordAny": ["news"]}, {"tickers": ["B"], "keywordAny": ["news"]}):
        got, want = (sorted(map(tuple, events.triggered(found, match, tags, v).collect())) for v in (index, nodes))
        assert got == want


@pytest.mark.parametrize("add", [False, True])
def test_nothing(spark, tmp_path, add):
    index = TextIndex(spark, str(tmp_path / "i"))
    if add:
        index.add(spark.createDataFrame([], NODES))
    assert search(spark, index, ["abc", "a"]) == []


@pytest.mark.parametrize("most", [0.0, 1e9])
def test_both_ways_equal_a_search_of_all(spark, tmp_path, most):
    """By lists, and by stretches of all texts; also after replacements, and for words that hold a piece twice."""
    nodes, index = drawn(5, 300), TextIndex(spark, str(tmp_path / "i"), most)
    index.add(spark.createDataFrame(nodes, NODES))
    index.add(spark.createDataFrame(drawn(6, 60), NODES))
    now = {**{n[0]: n for n in nodes}, **{n[0]: n for n in drawn(6, 60)}}
    words = ["abc", "ABCA", "aa", "ä", "ca b", "zzz", "abcdabcd", "bä", "aaa", None, "", "aaaa", "a b c", "ababab", "cab", "b  "]
    assert search(spark, index, words) == brute(now.values(), words)


def test_many_words_with_common_pieces_are_no_product(spark, tmp_path, monkeypatch):
    """Words that share all their pieces with most nodes would read each list for each word."""
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.range(3000).selectExpr("id", "concat('common ', id % 10) AS name", "null AS text"))
    monkeypatch.setattr(index, "_candidates", lambda rare: pytest.fail("candidates of all words"))
    words = spark.range(500).selectExpr("concat('common ', id) AS word")
    assert sorted(r["word"] for r in index.search(words).groupBy("word").count().collect()) == [f"common {i}" for i in range(10)]
