"""Quality by ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed features of a text (its words,
their shapes, and words that repeat the one before, dampened and normalised);
ordered thresholds cut the shared scale: P(grade <= k) = logistic(threshold_k -
weights . features). That gives an expected grade and, for selection, the
probability of at least a given grade.

Fitting runs on the driver over a bounded sample of the rated rows: at most
``max_rows`` of each grade, the first ones by a hash of doc_id. Every text is
scored, whole. Null and empty texts have no features and get the grade
probabilities of the thresholds alone. With fewer than two grades every text
gets the one there is (grade 0 without any). An empty table gives an empty
result; null and repeated ids are scored like others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, sample_texts

WORDS, SHAPES = 1 << 15, 1 << 12
SIZE = WORDS + SHAPES + 1
_SHAPE = bytes.maketrans(bytes(range(256)), bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)))


def _shape(word: bytes) -> bytes:
    kinds = word.translate(_SHAPE)
    return bytes(b for i, b in enumerate(kinds) if not i or kinds[i - 1] != b)


class Features:
    """Hashed features of texts; a bounded memo keeps the buckets of words met before."""

    def __init__(self, memo: int = 200_000):
        self.memo, self.known = memo, {}
        self.buckets = np.zeros((1 << 16, 2), np.int32)

    def __getstate__(self):
        return {"memo": self.memo}

    def __setstate__(self, state):
        self.__init__(state["memo"])

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, values) of one text."""
        words = (text or "").encode().split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        if len(known) > self.memo:
            known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        while len(known) + len(fresh) > len(self.buckets):
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
        for w in fresh:
            self.buckets[len(known)] = zlib.crc32(w.lower()) % WORDS, WORDS + zlib.crc32(_shape(w)) % SHAPES
            known[w] = len(known)
        own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        both = self.buckets[own]
        again = int((own[1:] == own[:-1]).sum())
        values = []
        numbers = []
        for column in (both[:, 0], both[:, 1]):
            number, count = np.unique(column, return_counts=True)
            value = np.log1p(count)
            numbers.append(number)
            values.append(value / np.sqrt((value**2).sum()))
        numbers.append(np.array([SIZE - 1]))
        values.append(np.array([again / len(words)]))
        return np.concatenate(numbers), np.concatenate(values)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class OrdinalModel:
    def __init__(self, texts: list[str], grades: list[int], steps: int = 200, rate: float = 0.05, decay: float = 1e-4):
        self.features = Features()
        self.grades = sorted(set(grades)) or [0]
        self.weights, self.cuts = np.zeros(SIZE), np.zeros(0)
        k = len(self.grades)
        if k < 2:
            return
        y = np.searchsorted(self.grades, grades)
        rows = [self.features.of(t) for t in texts]
        number, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        # each grade weighs the same, so that a rare one is learnt as well
        weight = 1.0 / (k * np.bincount(y, minlength=k)[y])
        share = np.cumsum(np.full(k, 1.0 / k))[:-1]
        first, gaps = np.log(share[0] / (1 - share[0])), np.log(np.maximum(1e-3, np.diff(np.log(share / (1 - share)))))
        p = np.concatenate([self.weights, [first], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            cuts = np.cumsum(np.concatenate([[p[SIZE]], np.exp(p[SIZE + 1 :])]))
            s = np.bincount(row, value * p[number], len(rows))
            edge = np.concatenate([[-np.inf], cuts, [np.inf]])
            high, low = _logistic(edge[y + 1] - s), _logistic(edge[y] - s)
            chance = np.maximum(high - low, 1e-12)
            up, down = weight * high * (1 - high) / chance, weight * low * (1 - low) / chance
            slope = up - down  # of the loss by the row's own score
            by_cut = np.bincount(y, -up, k)[:-1] + np.bincount(y, down, k)[1:]
            tail = np.cumsum(by_cut[::-1])[::-1]
            grad = np.concatenate([np.bincount(number, value * slope[row], SIZE) + decay * p[:SIZE], [tail[0]], tail[1:] * np.exp(p[SIZE + 1 :])])
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = p[:SIZE]
        self.cuts = np.cumsum(np.concatenate([[p[SIZE]], np.exp(p[SIZE + 1 :])]))

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= g) for each grade but the least, one row a text."""
        s = np.array([float(value @ self.weights[number]) for number, value in map(self.features.of, texts)] or np.zeros(0))
        return _logistic(s[:, None] - self.cuts[None, :])


def fit(docs: DataFrame, ratings: DataFrame, max_rows: int = 4000, max_chars: int = 8 << 20, max_grades: int = 100) -> OrdinalModel:
    """``ratings`` has doc_id and grade (whole numbers); held-out ids are left aside.

    Of each grade at most ``max_rows`` rows and ``max_chars`` characters are used; more
    than ``max_grades`` grades are an error.
    """
    usable = ratings.where("doc_id is not null and grade is not null").where(~held_out()).select("doc_id", "grade").distinct()
    grades = [r[0] for r in usable.select("grade").distinct().orderBy("grade").limit(max_grades + 1).collect()]
    if len(grades) > max_grades:
        raise ValueError(f"more than {max_grades} grades")
    texts, given = [], []
    for g in grades:
        picked = usable.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id")
        own = sample_texts(docs, picked, max_rows, max_chars)
        texts += own
        given += [int(g)] * len(own)
    return OrdinalModel(texts, given)


def grade(docs: DataFrame, model: OrdinalModel, at_least: int, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability of ``at_least``, keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        grades = np.array(own.grades, float)
        place = np.searchsorted(grades, at_least)
        for batch in batches:
            for start, texts in pieces(batch.column("text"), 1 << 20):
                tails = own.tails(texts)
                expected = grades[0] + tails @ np.diff(grades)
                chance = np.concatenate([np.ones((len(tails), 1)), tails], axis=1)
                tail = chance[:, place] if place < len(grades) else np.zeros(len(tails))
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array(expected, pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_probability", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, keep boolean")
