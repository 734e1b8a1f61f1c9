"""Operator 10, substring dedup by seeds that are extended.

Seeds are winnowed anchors: among the nine 5-grams of any 13 consecutive words the one with the least
hash is chosen, so that equal 13-word windows choose equal anchors, and the windows of a text fall into runs
that share an anchor. A run is the anchor extended both ways as far as windows choose it; its
fingerprint covers all the words of its windows. Documents are joined on anchors:

* a run whose fingerprint a smaller document also has is a repeat as a whole;
* a run whose anchor no smaller document has is no repeat;
* of the others (extension ends within the run), each window is compared with the windows of one
  document for each different fingerprint of the anchor. All extensions of an anchor, by every number of words
  both ways, are met at once by the hashes of their windows, instead of one pair of documents after the other.

Windows that repeat are merged into maximal repeats, (start, end) in words, and removed.

A document's own task settles what other documents of its partition settle, so a passage that very
many documents share sends one row for each partition and fingerprint into the join.

Defined results: null and empty texts have no words; texts below 13 words have no windows; what repeats
within one document only stays; rows of one doc_id do not remove each other's words; a null doc_id
removes nothing and loses nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MIX, Scratch, bytes_of, gram_hashes, mixed, only, word_hashes

WINDOW, GRAM = 13, 5
#: What is known about a run: a smaller document has it; its windows are to be looked up; it answers for others; both.
REPEATED, OPEN, ANSWERS = 1, 2, 4
SEEN = 400_000


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    return gram_hashes(h, window)


def runs(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, span, first, last) of each run: windows first to last choose the anchor; span is the fingerprint of their words."""
    n = len(h) - window + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    g = gram_hashes(h, gram)
    width = window - gram + 1
    at = np.zeros(n, np.int64)
    least = g[:n].copy()
    for j in range(1, width):
        x = g[j : j + n]
        less = x < least
        least[less] = x[less]
        at[less] = j
    chosen = np.arange(n) + at
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    # a polynomial over the words of the run, from windows at both its ends and all between: sums of mixed window hashes by place
    w = window_hashes(h, window)
    place = (np.arange(n) - chosen).astype(np.uint64)  # where in the run's frame the window stands
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(w + place * MIX))])
    span = mixed(total[last + 1] - total[first] + (last - first + 1).astype(np.uint64))
    return g[chosen[first]].view(np.int64), span.view(np.int64), first, last


def asked(window: int, gram: int):
    """(doc_id, text) -> (doc_id, ask, gone): the distinct runs of a document to be joined, and those that a smaller document of the partition has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            ask, gone = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                anchor, span, _, _ = runs(word_hashes(bytes_of(text.as_py()))[0], window, gram)
                mine, theirs = [], []
                if doc is not None:
                    for pair in dict.fromkeys(zip(anchor.tolist(), span.tolist(), strict=True)):
                        least = seen.get(pair)
                        if least is not None and least < doc:
                            theirs.append(pair)
                        else:
                            seen[pair] = doc
                            mine.append(pair)
                if len(seen) > SEEN:
                    seen.clear()
                ask.append(mine)
                gone.append(theirs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(lists(x) for x in (ask, gone))], ["doc_id", "ask", "gone"])

    return run


def lists(rows: list[list[tuple[int, int]]]) -> pa.Array:
    flat = np.array([p for r in rows for p in r], np.int64).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["anchor", "span"]))


def judged(ask: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, anchor, span, flag) of those runs ask(anchor, span, doc_id) whose anchor several documents have.

    Least documents are aggregated before they are shuffled, and met by joins whose skewed sides Spark splits, so
    an anchor or a passage that very many documents have is never gathered.
    """
    shared = ask.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    live = scratch.keep(ask.join(shared.select("anchor", "least"), "anchor").select("anchor", "span", "doc_id", "least"))
    spans = scratch.keep(live.groupBy("anchor", "span").agg(F.min("doc_id").alias("first"), F.min("least").alias("least")))
    # where a span begins later than its anchor, its first document must look its windows up in the other spans
    open_ = spans.groupBy("anchor").agg(F.bool_or(F.col("first") > F.col("least")).alias("open")).where("open")
    repeated = live.join(spans.select("anchor", "span", "first"), ["anchor", "span"]).where("doc_id > first").select("doc_id", "anchor", "span", F.lit(REPEATED).alias("flag"))
    told = spans.join(open_, "anchor").select(F.col("first").alias("doc_id"), "anchor", "span", F.when(F.col("first") > F.col("least"), OPEN + ANSWERS).otherwise(ANSWERS).alias("flag"))
    return repeated.union(told)


RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>"
STATE = RESULT + ", text string, windows array<struct<anchor:long,w:long,at:int,open:boolean>>"


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n words lie in a range."""
    mark = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(mark[:n]) > 0


def ranges(gone: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)


def kept_digest(data: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> str:
    """SHA-256 of the words that stay, joined by single spaces."""
    if not gone.any():
        return hashlib.sha256(b" ".join(data.split())).hexdigest()
    parts = [b" ".join(data[start[a] : end[b - 1]].split()) for a, b in ranges(~gone)]
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def range_lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty((0, 2), np.int64), *rows]).astype(np.int32)
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "end"]))


def settle(window: int, gram: int):
    """(doc_id, text, flags) -> STATE: results of documents with nothing open; the windows that are asked or answer; texts and what is gone already where something is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column("flags")
            bounds = np.concatenate([[0], np.cumsum(np.nan_to_num(flags.value_lengths().to_numpy(zero_copy_only=False)))]).astype(int)
            flat = [c.to_pylist() for c in flags.flatten().flatten()]
            n_words, n_removed, digests, repeats, texts = [], [], [], [], []
            windows: list[list[np.ndarray]] = [[], [], [], []]
            counts = [0]
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                data = bytes_of(text)
                a, b = bounds[row], bounds[row + 1]
                flag: dict[tuple[int, int], int] = {}
                for pair, f in zip(zip(flat[0][a:b], flat[1][a:b], strict=True), flat[2][a:b], strict=True):
                    flag[pair] = flag.get(pair, 0) | f
                made, is_open = 0, False
                h, start, end = word_hashes(data)
                gone = np.zeros(len(h), bool)
                if flag:
                    anchor, span, first, last = runs(h, window, gram)
                    of = np.array([flag.get(p, 0) for p in zip(anchor.tolist(), span.tolist(), strict=True)], np.int64)
                    repeated = of & REPEATED > 0
                    gone = cover(len(h), first[repeated], last[repeated] + window)
                    which = np.flatnonzero(~repeated & (of > 0))
                    if len(which):
                        at = windows_of(first, last, which)
                        length = (last - first + 1)[which]
                        here = np.repeat(of[which] & OPEN > 0, length)
                        is_open, made = bool(here.any()), len(at)
                        for x, v in zip(windows, (np.repeat(anchor[which], length), window_hashes(h, window)[at].view(np.int64), at.astype(np.int32), here), strict=True):
                            x.append(v)
                counts.append(made)
                n_words.append(len(h))
                n_removed.append(None if is_open else int(gone.sum()))
                digests.append(None if is_open else kept_digest(data, start, end, gone))
                texts.append(text if is_open else None)
                repeats.append(ranges(gone))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            columns = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(windows, kinds, strict=True)]
            found = pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.StructArray.from_arrays(columns, ["anchor", "w", "at", "open"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), range_lists(repeats), pa.array(texts, pa.string()), found], ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats", "text", "windows"])

    return run


def windows_of(first: np.ndarray, last: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Starts of all windows of the runs at `which`."""
    length = (last - first + 1)[which]
    return np.repeat(first[which] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())


def finish(window: int):
    """(doc_id, text, repeats, at) -> RESULT of documents that had open runs; repeats: what is gone already; at: starts of more windows that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, repeats = [], [], [], []
            for text, known, at in zip(batch.column("text"), batch.column("repeats"), batch.column("at"), strict=True):
                data = bytes_of(text.as_py())
                h, start, end = word_hashes(data)
                more = np.array(at.as_py() or [], np.int64)
                known = np.array([(r["start"], r["end"]) for r in known.as_py()], np.int64).reshape(-1, 2)
                gone = cover(len(h), np.concatenate([known[:, 0], more]), np.concatenate([known[:, 1], more + window]))
                n_words.append(len(h))
                n_removed.append(int(gone.sum()))
                digests.append(kept_digest(data, start, end, gone))
                repeats.append(ranges(gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), range_lists(repeats)], ["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by spaces), repeats (maximal repeats as word ranges)."""
    spark = docs.sparkSession
    texts = only(docs, "doc_id", "text")
    scratch = Scratch(spark, "op10", docs)
    pair = "array<struct<anchor:long,span:long>>"
    first = scratch.keep(texts.mapInArrow(asked(window, gram), f"doc_id long, ask {pair}, gone {pair}"))
    ask = first.select("doc_id", F.inline("ask")).select("anchor", "span", "doc_id")
    flags = scratch.keep(judged(ask, scratch).union(first.select("doc_id", F.inline("gone")).select("doc_id", "anchor", "span", F.lit(REPEATED).alias("flag"))))
    scratch.drop(first)
    per = flags.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "span", "flag")).alias("flags"))
    state = scratch.keep(texts.join(per.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "flags").mapInArrow(settle(window, gram), STATE), codec="zstd")
    scratch.drop(flags)
    spots = state.select("doc_id", F.inline("windows"))
    least = spots.groupBy("anchor", "w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor", "w", "least")
    found = spots.where("open").join(least, ["anchor", "w"]).where("least < doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("at").alias("at"))
    pending = state.where("n_removed is null").join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "repeats", "at")
    done = pending.mapInArrow(finish(window), RESULT)
    return scratch.few(state.where("n_removed is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", "repeats").union(done))
