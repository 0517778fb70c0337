import itertools
import re
from fractions import Fraction

import duckdb
import pytest
from helpers import LONG, SF, awkward, documents, nothing, words
from pyspark.sql import functions as F

from tickloom.llm import filter_audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, smaller):
    n = words(text)
    return {
        "A": len(n) < 200,
        "B": 100 * len(set(n)) < 50 * len(n),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": smaller,
    }


def brute(docs, labels):
    """Every order applied left to right, document by document."""
    big = float("inf")
    docs = [(big if i is None else i, t or "", s or "") for i, t, s in docs]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    seen = {}
    for i, t, _ in docs:
        seen[t] = min(seen.get(t, big), i)
    rows = [(s, i in good, i in toxic, fails(t, seen[t] < i)) for i, t, s in docs]
    out, fair = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [r for r in left if r[3][f]]
                left = [r for r in left if not r[3][f]]
                failing = [r for r in mine if r[3][f]]
                alone = sum(sum(r[3].values()) == 1 for r in failing)
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                fair[part, f] = fair.get((part, f), 0) + len(gone)
    return sorted((*key, *v, fair[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def as_rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def plain(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]


def test_equals_walking_all_orders(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = as_rows(queries.op12_filter_audit(spark, sf_dir))
    assert got == brute(plain(documents(spark)), [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.ORACLE})").fetchall()
    assert as_rows(queries.op12_filter_audit(spark, sf_dir)) == sorted(want)


def test_awkward_rows_and_labels(spark):
    """Null and repeated ids, texts and labels; a smaller id in another part; extra columns of clashing names."""
    docs = awkward(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame([(-5, LONG, "z"), (77, "A B| c", ""), (78, "A B| c", None)], "doc_id long, text string, source string"))
    rows = [(4, 1, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (9, None, 1), (2, 1, 0), (999, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("mask", F.lit("y"))
    known = [r for r in rows if r[0] is not None]
    assert as_rows(filter_audit.interactions(docs.withColumn("mask", F.lit("m")).withColumn("digest", F.lit("d")), labels)) == brute(plain(docs), known)


def test_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(nothing(spark), labels).collect() == []
    assert len(filter_audit.interactions(awkward(spark), labels).where("part = 'a'").collect()) == 600


def test_copies_do_not_meet_in_one_task(spark, sf_dir):
    """Rows meet the first id of their text by (digest, id), not by digest."""
    one = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("hot").alias("source"))
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.interactions(one, labels).collect()}
    first = got["EABCD", 1]
    assert (first["kept"], first["removed"], first["good_lost"], first["toxic_lost"]) == (1, 2999, 1, 1)
    # all texts fail A and half of each pair's credit is E's: 2999 * 60 by symmetry, and A's own one document
    assert first["shapley"] == 2999 * 60 and got["ABCDE", 1]["shapley"] == 2999 * 60 + 120


@pytest.mark.parametrize("counts", [[0, 3, 5, 7], [1, 0, 0, 0], [2, 9, 0, 4, 0, 0, 6, 1]])
def test_polynomial_corners_and_integrals(counts):
    p = filter_audit.Polynomial(counts)
    n = (len(counts) - 1).bit_length()
    for on in range(len(counts)):
        assert p.corner(on) == sum(c for mask, c in enumerate(counts) if mask & on)
    for f in range(n):
        assert p.shapley(f) == sum(Fraction(c, mask.bit_count()) for mask, c in enumerate(counts) if mask >> f & 1)
