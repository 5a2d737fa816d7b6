"""Severity by cumulative-link ordinal regression on sparse text features.

Features are counts of lower-cased words between white space and ASCII punctuation, and of their PREFIX first bytes, hashed to BITS bits. One weight vector serves all ordered thresholds:
P(grade <= k) = sigmoid(threshold_k - w.x). The model is fitted on a sample of at most ``sample`` labelled documents; weights
are kept for the features whose presence differs significantly between grades. Every document is scored over its whole text.

A null text has no features. Labels that are null, or of no document, are ignored. Documents with a null ``doc_id`` are scored.
Rows that repeat are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.store import small_batches
from factweave.llm.wordhash import NO_LETTER, U, Words, mix, slices

BITS, SAMPLE, FEATURES, PREFIX = 20, 8000, 4096, 4


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, counts, bounds of documents), features distinct inside a document."""
    words = Words(column, lower=True, space=NO_LETTER)
    doc = words.doc_of().astype(U) << U(BITS)
    key = np.concatenate((doc | (words.hashes() >> U(64 - BITS)), doc | (mix(words.hashes(PREFIX) + U(PREFIX)) >> U(64 - BITS))))
    pairs, n = np.unique(key, return_counts=True)
    doc = (pairs >> U(BITS)).astype(np.int64)
    return (pairs & U((1 << BITS) - 1)).astype(np.int64), n, np.searchsorted(doc, np.arange(words.docs + 1))


class Severity:
    """Weights of the chosen features, ascending thresholds."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, features: int = FEATURES, rounds: int = 400, ridge: float = 1e-5):
        self.grades = int(grades.max()) + 1 if len(grades) else 1
        index = np.concatenate([f for f, _ in rows]) if rows else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in rows]) if rows else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
        high = grades > 0
        # presence of a feature in graded and in clean documents, as a z score of the difference of shares
        size, n1, n0 = 1 << BITS, max(1, int(high.sum())), max(1, int((~high).sum()))
        a, b = (np.bincount(index[x[doc]], minlength=size) if len(index) else np.zeros(size) for x in (high, ~high))
        share = (a + b) / (n1 + n0)
        z = (a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
        chosen = np.argsort(-np.abs(z), kind="stable")[:features]
        chosen = np.sort(chosen[(np.abs(z[chosen]) > 4) & (a[chosen] + b[chosen] >= 5)])
        self.slot = np.full(size, -1, np.int32)
        self.slot[chosen] = np.arange(len(chosen))
        here = self.slot[index] >= 0 if len(index) else np.zeros(0, bool)
        cols, vals, at = self.slot[index[here]], np.log1p(count[here]), doc[here]
        self.weights, gaps = np.zeros(len(chosen)), np.zeros(max(self.grades - 1, 0))
        if self.grades < 2:
            self.thresholds = gaps
            return
        above = np.array([np.clip((grades > k).mean(), 1e-3, 1 - 1e-3) for k in range(self.grades - 1)])
        first = -np.log(above / (1 - above))
        params = np.concatenate((self.weights, first[:1], np.log(np.maximum(np.diff(first), 1e-2))))
        m, v = np.zeros_like(params), np.zeros_like(params)
        target = (grades[:, None] > np.arange(self.grades - 1)[None]).astype(float)
        for t in range(1, rounds + 1):  # Adam on the sum of the thresholds' logistic losses
            w, cut = params[: len(chosen)], self._cuts(params[len(chosen) :])
            score = np.bincount(at, vals * w[cols], minlength=len(grades))
            error = (1 / (1 + np.exp(np.clip(cut[None] - score[:, None], -30, 30))) - target) / len(grades)
            by_cut = -error.sum(0)
            tail = np.cumsum(by_cut[::-1])[::-1]
            grad = np.concatenate((np.bincount(cols, vals * error.sum(1)[at], minlength=len(chosen)) + ridge * w, tail[:1], tail[1:] * np.exp(params[len(chosen) + 1 :])))
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights, self.thresholds = params[: len(chosen)], self._cuts(params[len(chosen) :])

    @staticmethod
    def _cuts(raw: np.ndarray) -> np.ndarray:
        return raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))

    def exceed(self, index: np.ndarray, count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """P(grade > k) for every document and threshold k."""
        slot = self.slot[index]
        part = np.where(slot >= 0, np.log1p(count) * self.weights[np.maximum(slot, 0)], 0.0) if len(self.weights) else np.zeros(len(index))
        total = np.concatenate(([0.0], np.cumsum(part)))
        score = total[bounds[1:]] - total[bounds[:-1]]
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -30, 30)))


def grades_from_binary(rows: list[tuple[np.ndarray, np.ndarray]], flags: np.ndarray) -> np.ndarray:
    """Ordered grades for flagged documents: 0 not flagged, 1 and 2 up to and above the median number of telling words.

    Telling words are those in at least 5 flagged documents and 20 times as common there as elsewhere.
    """
    size = 1 << BITS
    n1, n0 = max(1, int(flags.sum())), max(1, int((1 - flags).sum()))
    a, b = np.zeros(size), np.zeros(size)
    for (f, _), y in zip(rows, flags, strict=True):
        (a if y else b)[f] += 1
    telling = (a >= 5) & ((a + 0.5) / n1 > 20 * (b + 0.5) / n0)
    found = np.array([c[telling[f]].sum() for f, c in rows])
    middle = np.median(found[flags == 1]) if flags.any() else 0.0
    return np.where(flags == 0, 0, np.where(found > middle, 2, 1)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", sample: int = SAMPLE) -> Severity:
    """A model from labels (doc_id, ``grade``). Grades 0 and 1 alone are spread by :func:`grades_from_binary`."""
    small_batches(docs.sparkSession)
    drawn = labels.filter(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(grade).cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                f, c, bounds = _features(batch.column(1))
                cuts = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), batch.column(2), pa.ListArray.from_arrays(cuts, pa.array(f, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(c, pa.int32()))],
                    names=["doc_id", "grade", "f", "c"],
                )

    got = texts.mapInArrow(run, "doc_id long, grade int, f array<int>, c array<int>").toArrow().combine_chunks().sort_by("doc_id")
    rows = [(np.asarray(f.values), np.asarray(c.values)) for f, c in zip(got["f"], got["c"], strict=True)]
    grades = got["grade"].to_numpy()
    if len(grades) and grades.max() == 1:
        grades = grades_from_binary(rows, grades)
    return Severity(rows, grades)


def score(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, expected_severity, grade (the most that is more likely reached than not), flagged (grade above 0)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                f, c, bounds = _features(batch.column(1))
                p = shared.value.exceed(f, c, bounds)
                grade = (p > 0.5).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(grade, pa.int32()), pa.array(grade > 0)], names=["doc_id", "expected_severity", "grade", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
