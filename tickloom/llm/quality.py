"""A quality classifier from positives and unlabelled text: non-negative unbiased risk (nnPU).

Trusted positives are documents labelled 1, the unlabelled sample is drawn from all documents, and the class prior is
the share of label 1 among the labelled rows. The model is additive over binned surface features of the whole text
(shares of character kinds, repeated words and lines, word lengths), so it never sees labels, language, source or id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import textblocks as tb
from tickloom.llm.common import fold, place, small_batches, unused, written

#: Bounds of the fitted sample: positives, unlabelled documents.
POSITIVES, UNLABELLED = 10_000, 20_000
THRESHOLD = 0.7

_KINDS = ("other", "lower", "upper", "digit", "space", "newline", "stop", "pipe", "shout", "high")
_KIND = np.zeros(256, np.int64)
for _k, _bytes in enumerate(("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".,;:'\"-?()", "|", "!")):
    _KIND[list(_bytes.encode())] = _k
_KIND[128:] = 9
_NOT_NEWLINE = np.arange(256) != 10
FEATURES = (*_KINDS, "mean_word", "short_words", "long_words", "distinct_words", "repeated_next", "distinct_lines", "log_words", "words_a_line", "spread")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a slice; all zero but for distinct shares of 1 if a text is empty."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    row = np.repeat(np.arange(n), length)
    counts = np.bincount(row * 10 + _KIND[data], minlength=10 * n).reshape(n, 10)
    share = counts / np.maximum(length, 1)[:, None]

    def distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        number = np.diff(first)
        own = np.repeat(np.arange(n, dtype=np.uint64), number)
        # sorted by text, then hash: a text's words stay together and equal words meet
        order = np.lexsort((hashes, own))
        h, o = hashes[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.where(number > 0, np.bincount(o[new].astype(np.int64), minlength=n) / np.maximum(number, 1), 1.0)

    starts, ends, first = tb.spans(data, offsets)
    hashes, size, number = tb.span_hashes(data, starts, ends), ends - starts, np.diff(first)
    of = np.repeat(np.arange(n), number)
    mean = lambda x: np.bincount(of, x, n) / np.maximum(number, 1)
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    l_starts, l_ends, l_first = tb.spans(data, offsets, _NOT_NEWLINE)
    lines = np.diff(l_first)
    mean_size = mean(size)
    spread = np.sqrt(np.maximum(mean(size.astype(float) ** 2) - mean_size**2, 0))
    return np.column_stack([share, mean_size, mean(size <= 3), mean(size >= 12), distinct(hashes, first), mean(same), distinct(tb.span_hashes(data, l_starts, l_ends), l_first), np.log1p(number), number / np.maximum(lines, 1), spread])


@dataclass
class Model:
    """Bin edges for each feature, a weight for each bin, a bias; and the prior that it was fitted with."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return 1 / (1 + np.exp(-np.clip(self.bias + sum(w[b[:, k]] for k, w in enumerate(self.weights)), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises prior * R_p+ + max(0, R_u- - prior * R_p-) with the logistic loss and Adam.

    Where the negative part falls below 0 its gradient is reversed, as in Kiryo et al. 2017. Nothing is random.
    """
    prior = float(np.clip(prior, 0.01, 0.99))
    both = np.concatenate([positive, unlabelled])
    edges = [np.unique(np.concatenate([np.quantile(both[:, k], [0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.93, 0.96, 0.98, 0.99, 0.995]), [np.nextafter(0, 1)]])) if len(both) else np.zeros(0) for k in range(len(FEATURES))]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(prior / (1 - prior))), prior)
    if not len(positive) or not len(unlabelled):
        return model
    start = np.cumsum([0, *(len(w) for w in model.weights)])
    p, u = (model.bins(x) + start[:-1] for x in (positive, unlabelled))
    w, bias = np.zeros(start[-1]), model.bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        zp, zu = w[p].sum(1) + bias, w[u].sum(1) + bias
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gu, gp_minus = sigmoid(zu) / len(u), -prior * sigmoid(zp) / len(p)
        gp_plus = -prior * sigmoid(-zp) / len(p)
        gp, gu = (gp_plus + gp_minus, gu) if negative >= 0 else (-gp_minus, -gu)
        g = np.bincount(p.ravel(), np.repeat(gp, p.shape[1]), len(w)) + np.bincount(u.ravel(), np.repeat(gu, u.shape[1]), len(w))
        g = np.append(g + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    model.weights, model.bias = [w[a:b] for a, b in zip(start[:-1], start[1:], strict=True)], float(bias)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, turn, text) to (positive, turn, x)."""
    for batch in batches:
        for row, end, data, offsets in tb.slices(batch.column(2)):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(row, end - row) for k in (0, 1)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["positive", "turn", "x"])


def _sample(docs: DataFrame, trusted: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(positive, features) of at most POSITIVES and UNLABELLED rows of ``docs`` (doc_id, text), however often ids repeat.

    The first distinct ids by a hash are chosen, small enough to broadcast at any size of the corpus; of the rows that
    bear them, which one repeated id could make as many as there are, the first by hash and features arrive.
    """
    turn = lambda salt: F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)).alias("turn")
    kinds = ((True, trusted, POSITIVES), (False, ids, UNLABELLED))
    chosen = [df.distinct().select("doc_id", turn(int(not mark))).orderBy("turn", "doc_id").limit(most).select("doc_id", "turn", F.lit(mark).alias("positive")) for mark, df, most in kinds]
    rows = docs.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").select("positive", "turn", "text").mapInArrow(_featured, "positive boolean, turn long, x array<double>")
    rows = written(rows, "quality-sample")
    parts = [rows.where(F.col("positive") == mark).orderBy("turn", "x").limit(most).select("x").toArrow() for mark, _, most in kinds]
    x = np.concatenate([np.asarray(p.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) for p in parts])
    return np.arange(len(x)) < parts[0].num_rows, x


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", test_fold: int | None = 2, folds: int = 4) -> Model:
    """Fits a model on documents outside ``test_fold`` (crc32 of the id modulo ``folds``; None: on all).

    The class prior is the share of label 1 among all labelled rows: it holds as far as documents were drawn for
    labelling at random, whatever label they then got. The labels of 0 serve for nothing else; risk is taken over positives and unlabelled texts.
    The sample is bounded: POSITIVES rows of documents with a label 1 and UNLABELLED of any, the first by a hash of their
    id, also where ids or labels repeat. A document with several labels is a positive if one is 1; null labels are
    skipped. Without positives every score is the prior.
    """
    small_batches(docs.sparkSession)
    keep = F.lit(True) if test_fold is None else fold("doc_id", folds) != test_fold
    marks = labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("label")).where("label IS NOT NULL").where(keep)
    ids = docs.select(docs[doc_id].alias("doc_id")).where("doc_id IS NOT NULL").where(keep)
    prior = marks.select(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    positive, x = _sample(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), marks.where("label = 1").select("doc_id"), ids)
    order = np.lexsort(x.T)
    x, positive = x[order], positive[order]
    return fit(x[positive], x[~positive], 0.5 if prior is None else prior)


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``: how likely label 1 is for the whole text. Null texts score as empty ones."""

    small_batches(docs.sparkSession)
    at = place(docs, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in tb.slices(batch.column(at)):
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(data, offsets)))], [*batch.schema.names, into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    return docs.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; rows of fold 2 of 4 are held out of the fit.

    Repeated rows are scored alike, null ids get a row, an empty table gives no rows.
    """
    model = train(docs, labels, doc_id, text, label)
    out = scored(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``, columns as they were; fold 2 of 4 stays out of the fit.

    Null texts are judged as empty ones, repeated rows alike; without positives every score is the prior. Columns may have
    any names, and an empty table stays one.
    """
    score = unused(docs, "score")
    return scored(docs, train(docs, labels, doc_id, text, label), text, score).where(F.col(score) >= threshold).drop(score)
