"""Small tables for the tests of the subpackage, and plain versions of what it computes."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
LONG = "The same long line about rivers and cities goes on and on until nobody reads it. " * 400


def awkward(spark):
    """Null, empty, very long, repeated and equal texts, null and repeated ids, and extra columns of clashing names."""
    texts = [
        (0, "one two three four five six seven"), (1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, LONG), (6, "one two three four five six seven"), (7, "short"), (8, "short"),
        (9, "ünï cödé text wïth öther letters and more words to fill the line up a bit"), (9, "ünï cödé text wïth öther letters and more words to fill the line up a bit"), (None, "a row without an id, but with a text of its own"), (None, None), (10, "12345 67890 !!!"),
    ]
    rows = [(i, t, [None, "en", "de"][k % 3], [None, "a", "b", "c"][k % 4], None) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("row", "node", "size", "block", "path", "list", "h", "copies", "label", "score", "shard", "__copy"):
        df = df.withColumn(name, F.lit(name))
    return df


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(nodes, links):
    """The smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
