"""Quality by ordinal cumulative-link regression on graded ratings.

A rating is one of K ordered grades.  One weight vector over hashed text features
is shared by all grades, and K - 1 ordered thresholds cut its score x.w:

    P(grade >= k) = sigmoid(x.w - threshold_k),  threshold_1 <= threshold_2 <= ...

The expected grade is the sum of these tail probabilities, and the tail
probability at a target grade selects documents.

Features are hashed: words and runs of punctuation, shapes of words (which
character classes follow each other), repeats of the last word or the one before,
and sizes of texts.  A feature's value is its count over the root of the text's
count of such tokens.

The model is fitted on a bounded sample of rated texts, about as many of each grade.
A null or empty text has the size feature only.  Unrated rows, and rows without a
doc_id, teach nothing; with fewer than two grades every tail probability is 1 for the
grades at or below the one that exists.  Extra columns are ignored, repeated rows are
each scored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkernel as K
from .columns import texts_of
from .samples import balanced, labelled_texts

BITS = 16
SAMPLE_EACH, RIDGE = 1000, 2e-4

# Byte classes for words and runs: 1 letters, 2 digits, 3 other.
_RUNS = np.full(256, 3, np.uint8)
_RUNS[[32, 9, 10, 11, 12, 13]] = 0
_RUNS[48:58] = 2
_RUNS[65:91] = _RUNS[97:123] = _RUNS[128:] = 1
# Byte to the character that stands for its class in shapes.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("9")
_SHAPE[65:91] = ord("^")
_SHAPE[97:123] = _SHAPE[128:] = ord("a")


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed feature, value) of each text's features; a feature of a row may come several times."""
    data, offsets = K.buffer_of(column)
    n = len(offsets) - 1
    runs = K.tokenize(data, offsets, _RUNS)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    shapes = K.tokenize(shape[keep], np.append(0, np.cumsum(keep))[offsets])
    words = K.tokenize(data, offsets)
    rows, hashes, values = [], [], []

    def add(row, hashed, salt, total):
        rows.append(row)
        with np.errstate(over="ignore"):
            hashes.append((K.mix(hashed + np.uint64(salt)) >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(1 / np.sqrt(np.maximum(total, 1))[row])

    each = np.arange(n, dtype=np.int64)
    for salt, tokens in ((1, runs), (2, shapes)):
        count = np.diff(tokens.bounds)
        add(np.repeat(each, count), tokens.hashes, salt, count)
    count = np.diff(words.bounds)
    row = np.repeat(each, count)
    for back in (1, 2):
        same = np.zeros(len(row), bool)
        same[back:] = (words.hashes[back:] == words.hashes[:-back]) & (row[back:] == row[:-back])
        add(row[same], np.zeros(int(same.sum()), np.uint64), 2 + back, count)
    add(each, np.minimum(np.log2(count + 1), 12).astype(np.uint64), 5, np.ones(n))
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(values)


def minimise(f, x: np.ndarray, rounds: int = 80, memory: int = 10) -> np.ndarray:
    """L-BFGS with backtracking; f gives value and gradient."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        rate, slope = 1.0 if steps else 1 / max(1.0, np.linalg.norm(g)), g @ q
        while True:
            new = x - rate * q
            v, h = f(new)
            if v <= value - 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        s, y = new - x, h - g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = value - v < 1e-7 * max(1.0, abs(value))
        x, value, g = new, v, h
        if done:
            break
    return x


class Model:
    """Weights of hashed features and the ordered thresholds; grades are 0..len(thresholds)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, column: pa.Array) -> np.ndarray:
        """Texts by grades 1..K-1: the probability of at least that grade."""
        row, feature, value = features(column)
        score = np.bincount(row, self.weights[feature] * value, len(column))
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def learn(column: pa.Array, grade: np.ndarray, grades: int) -> Model:
    """The ridge-penalised maximum-likelihood model; classes weigh the same."""
    rows, kinds, values = [], [], []
    for first in range(0, len(column), 256):  # features of a few texts at a time, each once
        row, feature, value = features(column.slice(first, 256))
        key, inverse = np.unique(row << BITS | feature, return_inverse=True)
        rows.append((key >> BITS) + first)
        kinds.append((key & ((1 << BITS) - 1)).astype(np.int32))
        values.append(np.bincount(inverse, value))
    row, feature, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, kinds, values))
    present = [k for k in range(grades) if (grade == k).any()]
    if len(present) < 2:
        only = present[0] if present else 0
        return Model(np.zeros(1 << BITS), np.where(np.arange(1, grades) <= only, -30.0, 30.0))
    used, column_of = np.unique(feature, return_inverse=True)
    n, m = len(grade), len(used)
    share = np.array([n / len(present) / max(1, (grade == k).sum()) for k in range(grades)])[grade]

    def unpack(x):
        return np.cumsum(np.append(x[m], np.exp(np.clip(x[m + 1 :], -20, 8))))

    def f(x):
        w, cut = x[:m], unpack(x)
        score = np.bincount(row, w[column_of] * value, n)
        low = np.append(-40.0, cut)[grade]
        high = np.append(cut, 40.0)[grade]
        a, b = (1 / (1 + np.exp(-np.clip(c - score, -40, 40))) for c in (low, high))
        p = np.maximum(b - a, 1e-12)
        loss = -(share * np.log(p)).sum() / n + RIDGE / 2 * (w @ w)
        da, db = a * (1 - a), b * (1 - b)
        pull = share * (db - da) / p / n  # of the score
        gradient = np.bincount(column_of, pull[row] * value, m) + RIDGE * w
        at_low, at_high = share * da / p / n, -share * db / p / n
        by_cut = np.array([at_low[grade == k + 1].sum() + at_high[grade == k].sum() for k in range(grades - 1)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        return loss, np.concatenate([gradient, tail[:1], tail[1:] * np.exp(np.clip(x[m + 1 :], -20, 8))])

    start = np.concatenate([np.zeros(m), [-0.5], np.zeros(grades - 2)])
    x = minimise(f, start)
    weights = np.zeros(1 << BITS)
    weights[used] = x[:m]
    return Model(weights, unpack(x))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, sample_each: int = SAMPLE_EACH) -> Model:
    """A model from documents (doc_id, text) and ratings (doc_id, grade from 0 to grades - 1).

    The sample is drawn from the ratings alone; its ids, 2 * sample_each * grades at
    most, are broadcast to the documents.
    """
    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
    chosen = balanced(rated, "grade", sample_each).collect()
    texts, marks = labelled_texts(docs, chosen, "grade") if chosen else (pa.array([], pa.string()), [])
    return learn(texts, np.array(marks, np.int64), grades)


def _apply(batches: Iterator[pa.RecordBatch], model, target: int, at: int, skip: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    for batch in batches:
        for part in K.slices(batch, at, 1 << 20):
            tails = model.tails(pc.fill_null(part.column(at), ""))
            grade = (tails >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*part.columns[skip:], pa.array(tails.sum(axis=1)), pa.array(tails[:, target - 1]), pa.array(grade, pa.int32())], [*part.schema.names[skip:], "expected_grade", "tail_probability", "grade"])


def grade(docs: DataFrame, model: Model, target: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, with expected_grade, tail_probability (of at least the target) and the median grade."""
    rows, schema, at, skip = texts_of(docs, keep)
    schema = StructType(list(schema)).add("expected_grade", "double").add("tail_probability", "double").add("grade", "integer")
    return rows.mapInArrow(partial(_apply, model=docs.sparkSession.sparkContext.broadcast(model), target=target, at=at, skip=skip), schema).toDF(*keep, "expected_grade", "tail_probability", "grade")
