import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import LONG, awkward, documents, nothing, words
from pyspark.sql import functions as F

from tickloom.llm import fingerprints, queries


def plain_paragraphs(text):
    """Counts of paragraphs, word by word."""
    out, now = [], []
    for line in text.replace("\r", "\n").split("\n"):
        for word in words(line):
            now.append(word)
            if word[-1] in ".!?" or len(now) == fingerprints.PARAGRAPH_WORDS:
                out.append(" ".join(now))
                now = []
        if now:
            out.append(" ".join(now))
            now = []
    return Counter(out)


def near(a, b):
    a, b = plain_paragraphs(a), plain_paragraphs(b)
    either = sum((a | b).values())
    return sum((a & b).values()) / either if either else 1.0


def brute(rows):
    """(id, n, sha, near_edited, near_next) in order of the ids; only for distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), near(t, changed), near(t, after)))
    return out


def test_equals_plain_version(spark, sf_dir):
    got = queries.op13_fingerprints(spark, sf_dir).orderBy("doc_id").collect()
    want = brute([(r["doc_id"], r["text"]) for r in documents(spark).collect()])
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([(r["near_edited"], r["near_next"]) for r in got], [w[3:] for w in want])
    assert {r["cells_edited"] for r in got} > {fingerprints.CELLS}  # some had to be sketched larger
    # fingerprints are a function of the text, edited or not
    again = {}
    for r in got:
        assert again.setdefault(r["edited_sha256"], r["edited_fingerprint"]) == r["edited_fingerprint"]
    text = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in documents(spark).collect()}
    for r in got:
        assert again.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(base64.b64decode(got[0]["fingerprint"])) == fingerprints.CELLS * 16


@pytest.mark.parametrize("ranges", ["1", "4", "50"])
def test_borders_of_ranges(spark, ranges):
    """Rows whose next stands in another range, empty ranges, and the last row's next."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i * 7, f"Line {i}.\nSecond of {i % 3}.\n" * (i % 5)) for i in range(40)] + [(None, "no id at all, ünï cödé 😀😀😀😀")]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    want = brute(rows)
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([(r["near_edited"], r["near_next"]) for r in got], [w[3:] for w in want])


def test_awkward_rows(spark):
    got = fingerprints.document_fingerprints(awkward(spark).withColumn("kind", F.lit("k")).withColumn("task", F.lit("t"))).collect()
    assert len(got) == awkward(spark).count()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_chars"] == 0 and by[1]["near_next"] == 1.0 and by[1]["near_edited"] == 1.0
    assert by[4]["n_chars"] == len(LONG) and by[4]["near_next"] == 1.0 and by[4]["fingerprint"] == by[5]["fingerprint"]
    assert by[7]["fingerprint"] == by[8]["fingerprint"] != by[0]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_no_rows_and_one(spark):
    assert fingerprints.document_fingerprints(nothing(spark)).collect() == []
    (one,) = fingerprints.document_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_differences_are_recovered(spark):
    """Every differing paragraph is found, whichever size it takes."""
    draw = random.Random(3)
    line = lambda: " ".join(draw.choice("abcdefgh") * draw.randint(1, 4) for _ in range(6)) + "."
    base = [line() for _ in range(3000)]
    versions = []
    for n, k in ((0, 0), (1, 0), (1, 1), (40, 3), (300, 40), (3000, 0), (3000, 200), (3000, 2900)):
        old = base[:n] + base[:2]
        new = [x if i >= k else line() for i, x in enumerate(old)]
        versions.append((len(versions), "\n".join(old), "\n".join(new)))
    versions.append((99, None, "only new. twice. twice."))
    for r in fingerprints.changed_paragraphs(spark.createDataFrame(versions, "gone_by long, old string, new string")).collect():
        a, b = plain_paragraphs(r["old"] or ""), plain_paragraphs(r["new"] or "")
        assert (len(r["gone"]), len(r["come"])) == (sum((a - b).values()), sum((b - a).values()))
        assert r["near"] == pytest.approx(near(r["old"] or "", r["new"] or ""))
        key, _ = fingerprints.digests(*fingerprints._flat([(r["old"] or "").encode()]))
        assert set(r["gone"]) <= set(key.view(np.int64).tolist())


def test_too_small_sketch_is_not_empty():
    key = fingerprints.mixed(np.arange(1, 200, dtype=np.uint64))
    cells = fingerprints.sketches(key, np.zeros(len(key), np.int64), 1, 24)
    empty, *_ = fingerprints.peel(*cells, 1, 24)
    assert not empty[0]
    cells = fingerprints.sketches(key, np.zeros(len(key), np.int64), 1, 648)
    empty, _, found, side = fingerprints.peel(*cells, 1, 648)
    assert empty[0] and set(found) == set(key) and set(side) == {1}
