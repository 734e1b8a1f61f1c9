"""Operator 3, quality classifier: naive Bayes support vectors on n-gram indicators.

A text becomes a set of indicators: n-grams, up to three long, of what its words look like (case,
digits, signs, length, whether a word or a line repeats), and its lower-cased words. Indicators are
hashed into `BUCKETS` columns, each scaled by the log ratio of its smoothed counts in both classes, and a
linear model with hinge loss is fitted by dual coordinate descent. The weights are drawn towards their mean
size, as the method does. A logistic curve on rows kept back makes margins probabilities.

Learns from at most `most_rows` labelled rows with `most_columns` indicators in all, those with the least
hash of doc_id, so that what the driver holds is bounded in rows and in bytes.

Defined results: null and empty texts have the indicator of an empty text alone; repeated rows are
scored alike; labels other than 0 and 1 are not learned from; if a class has no rows, every text
scores the smoothed share of label 1. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, WordHashes, gram_hashes, only, word_hashes
from .toxicity import logistic, sample

MOST_ROWS, MOST_COLUMNS = 20_000, 16_000_000
BUCKETS = 1 << 18
#: Strength of the fit, smoothing of the counts, and the share of the weights that is not drawn to their mean.
COST, SMOOTH, OWN = 0.1, 1.0, 0.25
EMPTY = np.uint64(0x5EED)
#: Words that the cache of shapes keeps, in bytes.
KEPT = 64
RUNS = re.compile(rb"([A-Z]+)|([a-z\x80-\xff]+)|([0-9]+)|([^A-Za-z0-9\x80-\xff])\4*")


class Shapes(dict):
    """word -> hash of its shape: kinds of runs in it and about how long it is."""

    def __missing__(self, word: bytes) -> int:
        kinds = b"".join(b"A" if m[1] else b"a" if m[2] else b"0" if m[3] else m[4] for m in RUNS.finditer(word))
        h = xxhash.xxh3_64_intdigest(kinds + b" %d" % min(len(word).bit_length(), 6))
        if len(word) <= KEPT:  # long ones are rare and would fill the memory
            if len(self) >= WordHashes.LIMIT:
                self.clear()
            self[word] = h
        return h


shapes = Shapes()


def indicators(text: str | None) -> np.ndarray:
    """The sorted distinct columns of a text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    found = [np.array([EMPTY + np.uint64(n.bit_length())])]
    if n:
        s = np.fromiter(map(shapes.__getitem__, words), np.uint64, n)
        w, _, _ = word_hashes(data.lower())
        again = np.zeros(n, np.uint64)
        again[1:] = (w[1:] == w[:-1]).astype(np.uint64)
        s = s * np.uint64(2) + again
        found += [gram_hashes(s, k) + np.uint64(k) for k in (1, 2, 3)]
        found.append(gram_hashes(w, 1))
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeated = len(lines) - len(set(lines))
        grams = gram_hashes(w, 3)
        twice = 10 * (len(grams) - len(np.unique(grams))) // max(len(grams), 1)
        kinds = 10 * len(np.unique(w)) // n
        long = min(n // max(len(lines), 1), 255).bit_length()
        odd = 10 * sum(1 for x in words if not x.rstrip(b".,!?").isalpha() and x.isascii()) // n
        found.append(np.array([11 + 16 * min(repeated, 3), 12 + 16 * twice, 13 + 16 * kinds, 14 + 16 * long, 15 + 16 * odd], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique((np.concatenate(found) >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    curve: tuple[float, ...]

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum() / np.sqrt(len(columns)) + self.bias)

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * (self.margin(indicators(text)) if a else 0.0) + b, -30, 30))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float, rounds: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with hinge loss; column `size` is a constant 1. y: 1 or -1; the classes weigh the same."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    upper = cost * np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == upper[i] else gradient
            if projected:
                most = max(most, abs(projected))
                new = min(max(alpha[i] - gradient / norm[i], 0.0), upper[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
        if most < 0.05:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, curve: np.ndarray) -> Model:
    """rows: columns of each text; y: 0 or 1; curve: which rows only the curve sees."""
    learn, kept = np.flatnonzero(~curve), np.flatnonzero(curve)
    counts = [np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)]
    for i in learn:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[rows[i]] / np.sqrt(len(rows[i])) for i in learn]
    w, bias = dual_coordinate_descent([rows[i] for i in learn], values, np.where(y[learn] > 0, 1.0, -1.0), BUCKETS, COST)
    w = (1 - OWN) * np.abs(w).mean() + OWN * w
    model = Model((w * ratio).astype(np.float32), bias * OWN, (1.0, 0.0))
    margins = np.array([[model.margin(rows[i])] for i in kept])
    model.curve = logistic(margins, y[kept].astype(float))
    return model


def columns_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [indicators(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), *(batch.column(c) for c in ("y", "curve", "key"))], ["x", "y", "curve", "key"])


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, most_rows: int = MOST_ROWS, most_columns: int = MOST_COLUMNS) -> Model:
    """Fits the model on labelled rows of docs for which `learn`, a condition on doc_id, holds."""
    scratch = Scratch(docs.sparkSession, "op3")
    rows = scratch.keep(sample(docs, labels, "quality", learn, most_rows, scratch).mapInArrow(columns_of, "x array<int>, y int, curve boolean, key long"))
    sizes = rows.select("key", F.size("x").alias("n")).toArrow()
    keys, n = sizes.column("key").to_numpy(), sizes.column("n").to_numpy()
    order = np.argsort(keys, kind="stable")
    over = np.flatnonzero(np.cumsum(n[order], dtype=np.int64) > most_columns)
    got = (rows.where(F.col("key") < int(keys[order[over[0]]])) if len(over) else rows).toArrow()
    y, curve = got.column("y").to_numpy(), got.column("curve").to_numpy()
    if not len(y) or not 0 < y[~curve].sum() < (~curve).sum() or not curve.any():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, (0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))))
    rows = [x.values.to_numpy() for x in got.column("x")]
    order = np.array(sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tobytes(), y[i])))  # whatever the order of arrival
    return fit([rows[i] for i in order], y[order], curve[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text), row by row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")
