"""Queries that take whole tables and whole texts, against plain Python."""

import re

import pytest

from tickloom.plans import queries as q


def tail(raw, length=6000):
    lines = re.sub(r"\x1b\[[0-9;]*m", "", raw).split("\n")
    return "\n".join(x for x in lines if not re.match(r"\s*(\d{4}-\d\d-\d\dT|$)", x, re.ASCII))[-length:]


@pytest.fixture(scope="module")
def texts():
    end = "\x1b[1mthe\x1b[0m end\n2024-05-05T10:00:00 noise\n \t\nlast line"
    return [(1, "first line\n" + "words and words\n" * 900 + end, "en"), (2, "kurz\n" + end, "de"), (3, "x" * 9000 + "é" * 5, None), (4, None, "fr"), (5, "", "en")]


def test_log_tails_of_whole_texts(spark, tmp_path, texts):
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tail"] for r in q.log_tails_whole(spark, str(tmp_path)).collect()}
    assert got == {i: tail("red line\n" + (t or "")) for i, t, _ in texts}
    assert got[1].endswith("the end\nlast line") and len(got[1]) == len(got[3]) == 6000
