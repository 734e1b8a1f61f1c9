"""Operator 9, n-gram Jaccard join: a MinHash LSH forest, then exact verification.

A document is its set of five-word shingles. Each of `trees` trees has a signature of the document, `depth`
MinHash values of a few bits each, packed into one number whose order is that of the tree's trie: a prefix of k
values is a node, and documents below one node match with k values. The forest keeps, in this order, only
what shares the shortest prefix that can be needed: the longest with which pairs at the threshold match in some
tree with probability `recall`.

Prefixes start at full depth and are shortened by one value a round. Documents that match are tied into
families, and within a family every pair is verified exactly, a block of documents against a block, by
counting shared shingles; a family that a round leaves as it was is not verified again. Every link found has a
known chance to be found with prefixes of this length, so the links say how many are still missing (with three
more at the threshold, as many as can be there unseen); prefixes are shortened until that is below
1 - `recall` of the links, or the shortest length is reached.

Copies (equal shingle sets) are joined first and carried as one representative with a count. A
family of any size is cut into blocks of at most `BLOCK` documents and `BLOCK_BYTES` of shingles, so a task holds
two blocks at most; it gives the number of links of each document and a spanning forest of its links, never
the pairs.

Defined results: null and empty texts have no shingles, no links, and are classes of their own; a text
of one to four words has one shingle, all its words; equal sets have similarity 1; repeated rows
count as copies; rows that share a doc_id, or have none, are told apart by their texts; a class without any
doc_id has the class_id null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import MIX, Scratch, bytes_of, connected, gram_hashes, mixed, only, row_key, word_hashes

SHINGLE, THRESHOLD, TREES, DEPTH, RECALL = 5, 0.8, 25, 7, 0.9999
BLOCK, BLOCK_BYTES = 512, 1 << 23
CHUNK = 4096


def met(similarity, length: int, trees: int):
    """The chance that two documents match in some tree with `length` values."""
    return 1 - (1 - similarity**length) ** trees


def shortest_prefix(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most values with which pairs at the threshold match with probability `recall`."""
    return next((k for k in range(depth, 1, -1) if met(threshold, k, trees) >= recall), 1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    h, _, _ = word_hashes(bytes_of(text))
    if 0 < len(h) < k:
        return gram_hashes(h, len(h)) + np.uint64(len(h))
    return np.unique(gram_hashes(h, k))


def signature(s: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One number a tree: `depth` MinHash values, the first in the highest of 63 bits."""
    n, bits = trees * depth, 63 // depth
    factor = (mixed(np.arange(1, n + 1, dtype=np.uint64) * MIX) | np.uint64(1))[:, None]
    least = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(s), CHUNK):
        x = s[None, i : i + CHUNK] * factor
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    values = (mixed(least) & np.uint64((1 << bits) - 1)).reshape(trees, depth)
    return (values << (np.arange(depth - 1, -1, -1, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64)


def prefix(k: int, depth: int) -> F.Column:
    """The node at level k."""
    return F.shiftright("signature", (63 // depth) * (depth - k))


def signatures(docs: DataFrame, trees: int, depth: int, k: int) -> DataFrame:
    """(doc_id, row, h1, h2, n, signatures): a 128-bit digest of the shingle set, its size, and a signature for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, n, every = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), k)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((d >> 64) - (1 << 63))
                h2.append((d & ((1 << 64) - 1)) - (1 << 63))
                n.append(len(s))
                every.append(signature(s, trees, depth).astype(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(every, pa.list_(pa.int64()))], ["doc_id", "row", "h1", "h2", "n", "signatures"])

    return only(docs, "doc_id", "text").select("doc_id", row_key().alias("row"), "text").mapInArrow(run, "doc_id long, row long, h1 long, h2 long, n long, signatures array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, as a matrix."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    size = np.diff(np.concatenate([first, [len(every)]]))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    twice = np.repeat(size > 1, size)
    column, owner = column[twice], owner[twice]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        a, b = np.searchsorted(column, [c, c + CHUNK])
        x = np.zeros((m, CHUNK), np.float32)
        x[owner[a:b], column[a:b] - c] = 1
        out += x @ x.T
    return out


def links_of(ids: np.ndarray, copies: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float, chances) -> Iterator[tuple]:
    """(a, b, links, found, missing) for documents with links.

    b is the least document that a hangs together with here; links counts copies, found does not; missing has for
    each function of `chances` how many links like these are expected to be missed.
    """
    n = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    union = n[:, None] + n[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= sides[:, None] != sides[None, :]
    count, found = linked @ copies, linked.sum(axis=1)
    x, y = np.nonzero(linked)
    similarity = shared[x, y] / union[x, y]
    missing = [np.bincount(x, 1 / c(similarity) - 1, len(ids)) for c in chances]
    root = np.arange(len(ids))
    while True:  # ids are sorted, so the least index is the least document
        least = np.minimum(root, np.where(linked, root[None, :], len(ids)).min(axis=1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    for i in np.flatnonzero(count):
        yield int(ids[i]), int(ids[root[i]]), int(count[i]), int(found[i]), [float(m[i]) for m in missing]


FOUND = "family long, a long, b long, links long, found long, missing array<double>"


def verify(threshold: float, chances):
    """Over rows sorted by (family, i, j, id): a block pair at a time."""

    def flush(key, rows) -> list[tuple]:
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])  # a repeated row comes once
        if len(rows) < 2:
            return []
        ids, copies, sides, sets = zip(*rows, strict=True)
        return [(key[0], *x) for x in links_of(np.array(ids), np.array(copies, np.float64), np.array(sides), list(sets), key[1] != key[2], threshold, chances)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def batch_of():
            kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["family", "a", "b", "links", "found", "missing"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "i", "j", "id", "copies", "side")]
            for *new, doc, copies, side, s in zip(*columns, batch.column("s"), strict=True):
                if new != key:
                    if rows:
                        out += flush(key, rows)
                    key, rows = new, []
                rows.append((doc, copies, side, np.frombuffer(s.as_py(), np.uint64)))
            if len(out) > 10_000:
                yield batch_of()
                out.clear()
        if rows:
            out += flush(key, rows)
        yield batch_of()

    return run


def with_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pa.array([shingles(t.as_py(), k).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "family", "copies", "blocks")], s], ["id", "family", "copies", "blocks", "s"])

    return run


def verified(docs: DataFrame, members: DataFrame, k: int, threshold: float, chances) -> DataFrame:
    """FOUND rows of members(id, family, copies, blocks): every pair of a family is compared, a block against a block."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = only(docs, "doc_id", "text").select(row_key().alias("id"), "text").join(members.hint("merge"), "id")  # members grow with the corpus
    sets = texts.select("id", "family", "copies", "blocks", "text").mapInArrow(with_sets(k), "id long, family long, copies long, blocks int, s binary")
    paired = sets.withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = paired.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "copies", "side", "s")
    return blocks.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j", "id").mapInArrow(verify(threshold, chances), FOUND)


def links(docs: DataFrame, classes: DataFrame, scratch: Scratch, threshold: float, k: int, trees: int, depth: int, recall: float) -> DataFrame:
    """FOUND rows of the classes (rep, n, copies, signatures) that are linked."""
    shortest = shortest_prefix(trees, depth, threshold, recall)
    lengths = range(depth, shortest - 1, -1)
    chances = [lambda s, n=n: met(s, n, trees) for n in lengths]
    entries = classes.select("rep", F.posexplode("signatures").alias("tree", "signature"))
    node = entries.groupBy("tree", prefix(shortest, depth).alias("node")).agg(F.count("*").alias("m")).where("m > 1").select("tree", "node")
    forest = scratch.keep(entries.withColumn("node", prefix(shortest, depth)).join(node, ["tree", "node"], "left_semi").select("tree", "signature", "rep").sortWithinPartitions("tree", "signature"))
    done, rounds = None, []
    for i, length in enumerate(lengths):
        level = forest.select("tree", prefix(length, depth).alias("node"), "rep")
        # documents below one node, as stars around the least one
        stars = level.groupBy("tree", "node").agg(F.min("rep").alias("b"), F.count("*").alias("m")).where("m > 1")
        tied = level.join(stars, ["tree", "node"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        member = connected(scratch, scratch.keep(tied)).select("id", "root").join(classes.select(F.col("rep").alias("id"), "n", "copies"), "id")
        family = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("id")).alias("mark"))
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") * 8 / BLOCK_BYTES)).cast("int")
        family = scratch.keep(family.select("root", F.xxhash64("root", "m", "mark").alias("family"), blocks.alias("blocks")))
        fresh = family if done is None else family.join(done, "family", "left_anti")
        members = scratch.keep(member.join(fresh, "root").select("id", "family", "copies", "blocks"))
        rounds.append(scratch.keep(verified(docs, members, k, threshold, chances)))
        done = family.select("family")
        found = rounds[0]
        for r in rounds[1:]:
            found = found.union(r)
        found = found.join(done, "family", "left_semi")  # what smaller families gave is in the larger ones again
        seen = found.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("missing")[i]), F.lit(0.0)).alias("missing")).first()
        if seen["missing"] / 2 + 3 * (1 / met(threshold, length, trees) - 1) <= (1 - recall) * seen["n"] / 2:
            break
    return scratch.keep(found)


def join(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, row (its key), class_id (the least doc_id that links lead to), first_row (the row that stands for
    the class), n_links (other rows with similarity >= threshold), copies."""
    scratch = Scratch(docs.sparkSession, "op9", docs)
    signed = scratch.keep(signatures(docs, trees, depth, k))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = scratch.keep(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("row").alias("rep"), head.alias("head"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("signatures").alias("signatures")))
    found = links(docs, classes, scratch, threshold, k, trees, depth, recall)
    per = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    root = scratch.keep(connected(scratch, found.select("a", "b")).select(F.col("id").alias("rep"), "root"))
    heads = root.join(classes.select("rep", "head"), "rep").groupBy("root").agg(F.min("head").alias("top"))
    linked = scratch.keep(root.join(heads, "root").join(per, "rep").select("rep", "top", "links"))
    tied = classes.select("h1", "h2", "rep", "head", "copies").join(linked, "rep", "left")
    tied = scratch.keep(tied.select("h1", "h2", "copies", F.coalesce("top", "head").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = signed.select("doc_id", "row", "h1", "h2", "n").join(tied, ["h1", "h2"], "left")
    some = F.col("n") > 0
    out = out.select("doc_id", "row", F.when(some, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(some, F.col("head.row")).otherwise(F.col("row")).alias("first_row"), F.when(some, F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(some, F.col("copies")).otherwise(1).cast("long").alias("copies"))
    return scratch.few(out)


def first_docs(docs: DataFrame, **settings) -> DataFrame:
    """docs with the row of least doc_id of each class; all columns stay as they are. Of repeated rows one stays."""
    scratch = Scratch(docs.sparkSession, "op9-first", docs)
    found = join(docs, **settings).groupBy("row").agg(F.min("first_row").alias("first_row"), F.count("*").alias("rows"))
    drop = scratch.keep(found.where("first_row <> row or rows > 1").select(F.col("row").alias("key"), (F.col("first_row") == F.col("row")).alias("repeated")))
    gone = drop.select("key")
    kept = docs.join(gone.hint("merge"), row_key() == gone["key"], "left_anti")
    if not drop.where("repeated").limit(1).count():
        return scratch.few(kept)
    again = drop.where("repeated").select("key")
    once = docs.join(again, row_key() == again["key"], "left_semi").withColumn("__row", row_key()).dropDuplicates(["__row"]).drop("__row")
    return scratch.few(kept.union(once))
