"""Operator 6, toxicity: class-conditional Kneser-Ney models of how words are spelt.

The models are over the characters of a word, so that a new form of a known insult is still known by
its stem. The top order keeps discounted counts for each class, with a discount for each of the counts 1, 2
and 3 or more (modified Kneser-Ney) that leaves little of the rarest; all orders below are shared:
their continuation counts come from every document, labelled or not, so that a rare expression gets
the same backoff probability from both models and weighs little. A word's log-likelihood ratio
compares the two models; a text's statistics are the mean ratio a word (length-normalised) and the means
over its `TOPS` most telling words, each cut off at `CUT` so that no single odd word decides. A logistic
curve, fitted on training rows that the models have not seen, turns them into a probability.

The class models learn from at most `most_rows` labelled rows, those with the least hash of doc_id.
The shared counts cover all documents. What is sent to the workers has a fixed size: n-grams are
hashed into `BUCKETS` buckets.

Defined results: null and empty texts and texts without words score like ordinary texts of ratio 0;
repeated rows are scored alike; labels other than 0 and 1 are not learned from (a document with two
labels counts as toxic); if a class has no rows, every text scores the share of toxic rows, smoothed.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, mapped, only

MOST_ROWS, CURVE_SHARE = 20_000, 0.3
ORDER, DISCOUNT, BUCKETS, CUT = 5, 0.75, 1 << 20, 8.0
#: Of the class counts 0, 1, 2, and 3 or more: an n-gram that one labelled text has says next to nothing.
CLASS_DISCOUNTS = np.array([0.0, 0.95, 1.9, 2.85])
TOPS = (1, 3, 9)
STATISTICS = 1 + len(TOPS)
WORD = re.compile(r"[^\W_]+")
PAD, END = "^", "$"
CACHE = 300_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, order: int = ORDER) -> list[str]:
    padded = PAD * (order - 1) + word + END
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def bucket(gram: str) -> int:
    """As `bucket_of` does in Spark."""
    return xxhash.xxh64_intdigest(gram.encode("utf-8", "replace"), 42) & (BUCKETS - 1)


def bucket_of(gram) -> F.Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class Model:
    """seen: log ratio of each top-order n-gram's bucket (nan: in neither class); unseen: that of each context's backoff weights."""

    seen: np.ndarray
    unseen: np.ndarray
    curve: tuple[float, ...] = (0.0,) * (STATISTICS + 1)
    words: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"words": {}}

    def learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            new = list(words)
        if not new:
            return
        every, length = [], []
        for w in new:
            g = grams(w)
            every += g
            length.append(len(g))
        r = self.seen[[bucket(x) for x in every]]
        neither = np.flatnonzero(np.isnan(r))
        r[neither] = self.unseen[[bucket(every[i][:-1]) for i in neither]]
        self.words.update(zip(new, np.add.reduceat(r, np.concatenate([[0], np.cumsum(length)[:-1]])).tolist(), strict=True))

    def statistics(self, text: str | None) -> np.ndarray:
        out, words = np.zeros(STATISTICS), tokens(text)
        if not words:
            return out
        self.learn_words(set(words))
        r = np.fromiter(map(self.words.__getitem__, words), float, len(words))
        most = min(len(r), max(TOPS))
        top = np.zeros(max(TOPS))
        top[:most] = np.minimum(np.sort(np.partition(r, len(r) - most)[-most:])[::-1], CUT)
        out[0], out[1:] = r.mean(), [top[:k].mean() for k in TOPS]
        return out

    def score(self, text: str | None) -> float:
        weights, intercept = np.array(self.curve[:-1]), self.curve[-1]
        x = weights @ self.statistics(text) if weights.any() else 0.0
        return float(1 / (1 + np.exp(-np.clip(x + intercept, -30, 30))))


def lower_orders(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shared interpolated probabilities by bucket. levels: (gram, context, suffix, continuations), order 1 first."""
    low = np.full(BUCKETS, 1.0)
    for k, (gram, context, suffix, n) in enumerate(levels):
        n = n.astype(float)
        p = np.zeros(BUCKETS)
        if k == 0:
            p[gram] = n / max(n.sum(), 1)
        else:
            total, kinds = np.bincount(context, n, BUCKETS), np.bincount(context, minlength=BUCKETS)
            p[gram] = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds[context] * low[suffix]) / total[context]
        low = p
    return low


def ratios(top: tuple[np.ndarray, ...], low: np.ndarray) -> Model:
    """top: (gram, context, suffix, ordinary count, toxic count)."""
    gram, context, suffix, *counts = top
    p, weight = [], []
    for c in counts:
        c = c.astype(float)
        taken = CLASS_DISCOUNTS[np.minimum(c, 3).astype(int)]
        total = np.bincount(context, c, BUCKETS)
        w = np.where(total > 0, np.bincount(context, taken, BUCKETS) / np.maximum(total, 1), 1.0)
        weight.append(w)
        p.append((c - taken) / np.maximum(total[context], 1) + w[context] * np.maximum(low[suffix], 1e-9))
    seen = np.full(BUCKETS, np.nan, np.float32)
    seen[gram] = np.log(p[1] / p[0])
    return Model(seen, np.log(weight[1] / weight[0]).astype(np.float32))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.05) -> tuple[float, ...]:
    """Weights and intercept of a penalised logistic regression on standardised columns, by Newton's method."""
    if len(set(y.tolist())) < 2:
        return (0.0,) * x.shape[1] + (float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))),)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.diag([pull] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    a = w[:-1] / scale
    return (*map(float, a), float(w[-1] - a @ mean))


def corpus_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (g): the distinct top-order n-grams of a partition's words (again, if they are too many to keep).

    A word is spelt when it is met, so that no more than the words and n-grams themselves are held."""
    words: set[str] = set()
    found: set[str] = set()
    for batch in batches:
        for text in batch.column(0):
            for w in tokens(text.as_py()):
                if w not in words:
                    words.add(w)
                    found.update(grams(w))
            if len(words) > CACHE:
                words.clear()
            if len(found) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["g"])
                found.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], ["g"])


def class_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (g, c0, c1): in how many documents' word lists of each class, words counted once a document."""
    for batch in batches:
        words: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
            for w in set(tokens(text.as_py())):
                words.setdefault(w, [0, 0])[y] += 1
        seen: dict[str, list[int]] = {}
        for w, c in words.items():
            for g in grams(w):
                s = seen.setdefault(g, [0, 0])
                s[0] += c[0]
                s[1] += c[1]
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([c[0] for c in seen.values()], pa.int64()), pa.array([c[1] for c in seen.values()], pa.int64())], ["g", "c0", "c1"])


def arrays(df: DataFrame) -> tuple[np.ndarray, ...]:
    """Columns of a table that has one row a bucket at most."""
    got = df.toArrow()
    return tuple(got.column(i).to_numpy() for i in range(got.num_columns))


def sample(docs: DataFrame, labels: DataFrame, name: str, learn: F.Column, most_rows: int, scratch: Scratch) -> DataFrame:
    """(text, y, curve, key) of at most most_rows labelled rows; a part by hash is for the curve; key is the hash that rows are chosen by."""
    marked = only(labels, "doc_id", name).where(F.col(name).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(name).cast("int").alias("y"))
    chosen = scratch.keep(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    curve = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1000)) < int(1000 * CURVE_SHARE)
    return scratch.keep(only(docs, "doc_id", "text").join(chosen, "doc_id").select("text", "y", curve.alias("curve"), F.xxhash64("doc_id").alias("key")))


def train(docs: DataFrame, labels: DataFrame, learn: F.Column, most_rows: int = MOST_ROWS) -> Model:
    """Fits the models on labelled rows of docs for which `learn`, a condition on doc_id, holds."""
    scratch = Scratch(docs.sparkSession, "op6")
    rows = sample(docs, labels, "toxic", learn, most_rows, scratch)
    per = {r["curve"]: r for r in rows.groupBy("curve").agg(F.count("*").alias("n"), F.sum("y").alias("t")).collect()}
    n, toxic = sum(r["n"] for r in per.values()), sum(r["t"] for r in per.values())
    empty = Model(np.full(BUCKETS, np.nan, np.float32), np.zeros(BUCKETS, np.float32), (0.0,) * STATISTICS + (float(np.log((toxic + 0.5) / (n - toxic + 0.5))),))
    if len(per) < 2 or not 0 < per[False]["t"] < per[False]["n"]:
        return empty
    classes = rows.where("not curve").select("text", "y").mapInArrow(class_grams, "g string, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    shared = only(docs, "text").mapInArrow(corpus_grams, "g string").distinct()
    every = scratch.keep(shared.join(classes, "g", "left").select("g", F.coalesce("c0", F.lit(0)).alias("c0"), F.coalesce("c1", F.lit(0)).alias("c1")))
    left = lambda k: F.expr(f"left(g, {k})")
    right = lambda k: F.expr(f"right(g, {k})")
    levels, kinds = [], every.select("g")
    for k in range(ORDER - 1, 0, -1):
        kinds = kinds.select(right(k).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
        levels.insert(0, arrays(kinds.groupBy(bucket_of("g").alias("b")).agg(F.min(bucket_of(left(k - 1))), F.min(bucket_of(right(k - 1))), F.sum("n"))))
        kinds = kinds.select("g")
    top = arrays(every.where("c0 + c1 > 0").groupBy(bucket_of("g").alias("b")).agg(F.min(bucket_of(left(ORDER - 1))), F.min(bucket_of(right(ORDER - 1))), F.sum("c0"), F.sum("c1")))
    model = ratios(top, lower_orders(levels))
    model.curve = empty.curve
    names = [f"s{i}" for i in range(STATISTICS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([model.statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*map(pa.array, got.T), batch.column("y")], [*names, "y"])

    *x, y = arrays(rows.where("curve").select("text", "y").mapInArrow(measure, ", ".join(f"{c} double" for c in names) + ", y int"))
    order = np.lexsort((y, *x))
    model.curve = logistic(np.column_stack(x)[order], y[order].astype(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of docs(doc_id, text), row by row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def clean_docs(docs: DataFrame, model: Model, limit: float = 0.3) -> DataFrame:
    """docs without those that score `limit` or more; all columns stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t.as_py()) < limit for t in batch.column(place)], pa.bool_()))

    return mapped(docs, run)
