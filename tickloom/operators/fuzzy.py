"""Nearest names of one table in another by edit distance, without comparing all with all.

Names within k edits have a form in common after at most k letters are deleted from each. Forms meet in a join by hash, the
distance is then checked exactly. Distances are tried in turn, so that names with an equal or very near one never make the
many forms of the next; forms that very many names share are dealt to several tasks. Joins are shuffled by a hint: Spark
takes tables of forms for as small as the names they were made from, and would broadcast them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.shared import cut

#: Pairs that one form may make in one task.
PAIRS = 100_000


def _shorter(forms: Column) -> Column:
    """All forms with one letter less, and the forms themselves."""
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    less = F.flatten(F.transform(F.filter(forms, lambda s: s != ""), without))
    return F.array_distinct(F.concat(forms, less))


def _reached(names: DataFrame, others: DataFrame, edits: int) -> DataFrame:
    """Those of ``names`` with one of ``others`` near enough in length, dealt to as many tasks as a shuffle has."""
    lengths = others.select(F.explode(F.sequence(F.length("name") - edits, F.length("name") + edits)).alias("n")).distinct()
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.join(F.broadcast(lengths), F.length("name") == F.col("n"), "left_semi").repartition(tasks, F.xxhash64("name"))  # not the names' own dealing, which Spark would take for done


def _forms(names: DataFrame, edits: int) -> DataFrame:
    """(name, form): hashes of each name with up to ``edits`` letters deleted."""
    forms = F.array(F.col("name"))
    for _ in range(edits):
        forms = _shorter(forms)
    return names.select("name", F.explode(F.transform(forms, lambda s: F.xxhash64(s))).alias("form"))


def near_pairs(left: DataFrame, right: DataFrame, edits: int = 2, pairs: int = PAIRS) -> DataFrame:
    """(name, other, edits) of all names of ``left`` and ``right`` (name) that are at most ``edits`` apart, each pair once.

    Names are compared as they are; null ones have no pairs. A name of n letters has some n ** edits forms.
    """
    one, two = (df.select("name").where("name IS NOT NULL").distinct() for df in (left, right))
    a, b = (cut(_forms(_reached(side, other, edits), edits)) for side, other in ((one, two), (two, one)))
    number = lambda df, n: df.groupBy("form").agg(F.count("*").alias(n))
    # only forms that both sides have, and in how many tasks each one's pairs are made
    shared = number(a, "m").join(number(b, "n").hint("merge"), "form").select("form", F.ceil(F.col("m") * F.col("n") / F.lit(float(pairs))).cast("int").alias("parts"))
    crowded = cut(shared.where("parts > 1"))
    if crowded.isEmpty():
        met = a.join(b.withColumnRenamed("name", "other").hint("merge"), "form")
    else:
        parts = F.coalesce("parts", F.lit(1))
        a = a.join(crowded.hint("merge"), "form", "left").withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int")).drop("parts")
        b = b.join(crowded.hint("merge"), "form", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = a.join(b.withColumnRenamed("name", "other").hint("merge"), ["form", "part"])
    near = met.select("name", "other").where(F.abs(F.length("name") - F.length("other")) <= edits).distinct()
    return near.withColumn("edits", F.levenshtein("name", "other")).where(F.col("edits") <= edits)


def nearest_names(left: DataFrame, right: DataFrame, name: str = "name", edits: int = 2, into: str = "nearest") -> DataFrame:
    """``left`` with ``into``: the name of ``right`` with the fewest edits from its own, whatever the case, and ``edits`` of them.

    Of equally near ones the first by code point is taken; null beyond ``edits``.
    """
    known = right.select(F.col(name).alias("other"), F.lower(name).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.min("other").alias("other"))
    known, open_ = cut(known), cut(left.select(F.lower(name).alias("name")).where("name IS NOT NULL").distinct())
    found = None
    for k in range(edits + 1):
        if k == 0:
            best = open_.join(known.hint("merge"), "name").select("name", "other", F.lit(0).alias("edits"))
        else:
            pairs = near_pairs(open_, known, k).withColumnsRenamed({"name": "of", "other": "name"})
            best = pairs.join(known.hint("merge"), "name").groupBy("of").agg(F.min(F.struct("edits", "other")).alias("b")).select(F.col("of").alias("name"), "b.other", "b.edits")
        best = cut(best)
        found = best if found is None else found.unionAll(best)
        open_ = cut(open_.join(best.select("name").hint("merge"), "name", "left_anti"))
    found = found.select(F.col("name").alias("__own"), F.col("other").alias(into), "edits")
    return left.join(found.hint("merge"), F.lower(left[name]) == F.col("__own"), "left").drop("__own")
