"""Audit of filters that act on the same documents: what each removes in every order, and its fair share by Shapley value.

Each document fails a set of filters, its mask. What a set of filters removes is a polynomial of one variable a filter:
a mask's documents go as soon as one of its filters is on, 1 - prod(1 - x_i) over the mask. Counts by mask give the
polynomial's coefficients; a corner (filters on or off) evaluates to the number removed, and a filter's Shapley value is
the integral of its partial derivative along the diagonal from (0, ..., 0) to (1, ..., 1). Coefficients and integrals are
exact rationals; 120 times a Shapley value is the sum over all orders of five filters, a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from functools import cache
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, only, written

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails; all depend on nothing but the text, null being empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n = F.size(words)
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]", "")) > MAX_CAPITALS * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


class Polynomial:
    """A multilinear polynomial: exact coefficients by set of variables (bits); the constant is zero."""

    def __init__(self, counts: Sequence[int]):
        """What sets of filters remove, given documents by mask: 1 - prod(1 - x_i) = sum over parts T of the mask, not empty, of (-1)^(|T|+1) prod(x_i in T)."""
        above = list(counts)
        for bit in range((len(counts) - 1).bit_length()):  # sums over all masks that hold T
            for at in range(len(counts)):
                if not at >> bit & 1:
                    above[at] += above[at | 1 << bit]
        self.terms = {at: Fraction(n if at.bit_count() % 2 else -n) for at, n in enumerate(above) if at and n}

    def corner(self, on: int) -> int:
        """The value where the variables in ``on`` are 1 and all others 0."""
        return int(sum((c for at, c in self.terms.items() if at & ~on == 0), Fraction(0)))

    def shapley(self, variable: int) -> Fraction:
        """The integral over t of the derivative by one variable at (t, ..., t): each term gives its coefficient over its size."""
        return sum((c / at.bit_count() for at, c in self.terms.items() if at >> variable & 1), Fraction(0))


@cache
def _orders(n: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Every order by name, with (filters before, filter) of each step."""
    out = []
    for order in permutations(range(n)):
        before, steps = 0, []
        for f in order:
            steps.append((before, f))
            before |= 1 << f
        out.append(("".join(FILTERS[f] for f in order), steps))
    return out


def audit(counts: Sequence[int], good: Sequence[int], toxic: Sequence[int]) -> list[tuple]:
    """All (order, step) rows of one part, given its documents, good ones and toxic ones by mask."""
    n, total = (len(counts) - 1).bit_length(), sum(counts)
    gone = [[p.corner(on) for on in range(len(counts))] for p in map(Polynomial, (counts, good, toxic))]
    whole = Polynomial(counts)
    fair = [whole.shapley(f) * factorial(n) for f in range(n)]
    fails = [gone[0][1 << f] for f in range(n)]
    rows = []
    for name, steps in _orders(n):
        for k, (before, f) in enumerate(steps):
            after = before | 1 << f
            lost, good_lost, toxic_lost = (g[after] - g[before] for g in gone)
            rows.append((name, k + 1, total - gone[0][after], lost, fails[f] - lost, counts[1 << f], good_lost, toxic_lost, int(fair[f])))
    return rows


def _audits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A few parts at a time, as each makes 600 rows."""
    names = [c.split()[0] for c in OUT.split(", ")]
    for frame in frames:
        for at in range(0, len(frame), 50):
            rows = [(part, *row) for part, n, good, toxic in frame.iloc[at : at + 50].itertuples(index=False) for row in audit(*([int(x) for x in a] for a in (n, good, toxic)))]
            yield pd.DataFrame(rows, columns=names)


def with_masks(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, text: str = "text") -> DataFrame:
    """(digest, doc_id, part, mask of the filters before the last, n, good, toxic): rows of equal values counted together.

    Digests are 128 bits of the whole text. Labels are first brought to one row a doc_id (good or toxic if any row says
    so); rows without a doc_id have no label, and are dealt by their text, so that many of them aren't one task.
    """
    failures = failures or text_failures(F.col("text"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures.values())), F.lit(0))
    rows = only(docs, doc_id="doc_id", part="source", text=text)
    rows = rows.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "doc_id", F.coalesce("part", F.lit("")).alias("part"), mask.alias("mask"))
    rows = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    known = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("of"))
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), "digest"))
    times = lambda c: (F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c)
    return rows.withColumn("of", own).join(known, "of", "left").select("digest", "doc_id", "part", "mask", "n", times("good"), times("toxic"))


def interactions(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each part (value of ``source``, null as empty), order of the five filters and step.

    kept after the step, removed in it, redundant (fails its filter, but went earlier), unique_fails (fails it alone),
    good_lost and toxic_lost (removed in it, by the labels), shapley (what its filter removes, summed over all orders).
    ``failures`` may replace A to D by other conditions on the column ``text``. The last filter is failed by each document
    whose whole text also stands under a smaller doc_id, in any part: copies under one id don't fail each other, and a
    missing id is larger than all others. Null texts are empty, repeated rows count each, no rows give no rows.

    Texts stay where they are: only digests travel. The first id of a text is found by an aggregate, and rows meet it by
    (digest, id), so that neither many copies of a text nor a large source make a large task.
    """
    rows = written(with_masks(docs, labels, failures), "filter-masks")
    last = 1 << (len(failures) if failures else len(FILTERS) - 1)
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    whole = rows.groupBy("part", "mask").agg(*sums)
    kept = rows.join(first, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))).groupBy("part", "mask").agg(*sums)
    less = kept.select("part", F.col("mask") + last, *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    cells = whole.withColumn("mask", F.col("mask") + last).unionAll(less).unionAll(kept).groupBy("part", "mask").agg(*sums)
    cell = lambda c, k: F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0)).cast("long")
    parts = cells.groupBy("part").agg(*[F.array(*[cell(c, k) for k in range(2 * last)]).alias(c) for c in ("n", "good", "toxic")])
    return parts.mapInPandas(_audits, OUT)


#: The same by brute force: every order walked step by step over documents by mask.
ORACLE = """WITH RECURSIVE firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS low FROM documents GROUP BY ALL),
 lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 w AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(d.text, '') AS text, regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents d),
 m AS (SELECT part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
   + CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END
   + CASE WHEN w.doc_id > low OR (w.doc_id IS NULL AND low IS NOT NULL) THEN 16 ELSE 0 END) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
   FROM w JOIN firsts f ON f.text = w.text LEFT JOIN lab ON lab.doc_id = w.doc_id),
 n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
 walk AS (SELECT '' AS name, 0 AS bits UNION ALL SELECT name || chr(65 + f::INT), bits + (1 << f::INT) FROM walk, range(5) r(f) WHERE bits & (1 << f::INT) = 0),
 orders AS (SELECT name FROM walk WHERE bits = 31),
 steps AS (SELECT o.name AS filter_order, s::INT AS step, name[s] AS letter, 1 << (ascii(name[s]) - 65) AS bit, (SELECT coalesce(sum(1 << (ascii(name[k]) - 65)), 0)::INT FROM range(1, s) r(k)) AS earlier FROM orders o, range(1, 6) q(s)),
 rows_ AS (SELECT part, filter_order, step, letter, sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
   sum(CASE WHEN mask & earlier <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
   sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & earlier = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM n, steps GROUP BY ALL)
 SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM rows_"""
