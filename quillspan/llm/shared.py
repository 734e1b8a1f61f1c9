"""Helpers that several operators share: the shared folder, intermediate tables, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: what `bytes.split()` also splits on.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or where that is unset on a single machine (tests) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that no executor needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillspan-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


class Scratch:
    """Intermediate Parquet tables of one operator call, in the shared folder.

    A written table cuts the lineage, survives lost executors, and has a size that Catalyst knows,
    so that it broadcasts a table only below `spark.sql.autoBroadcastJoinThreshold`.
    """

    #: Codecs that keep buffers outside the heap until the next full collection make many small files costly.
    codec = "none"
    #: Bytes of the input to a file of a tidy scratch.
    FILE = 12 << 20
    #: No empty file that marks a table as whole: `keep` returns when it is. For paths of `file:` only: files without a second one for their
    #: checksum. Pages have checksums of their own.
    plain = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    #: Removes a query's shuffle files when it has ended, instead of when the driver collects its garbage.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, of: DataFrame | None = None):
        """of: where given, the scratch is tidy: its tables have files by the size of `of`, however many partitions there are, and no shuffle outlives its table.

        Hadoop's local file system starts a `chmod` for each file, its checksum and its folder, and until such a
        process runs its own program it is seen to have all the memory of its executor, besides the executor.
        """
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.tidy = of is not None
        self.files = min(bytes_in(of) // self.FILE, 2**31 - 1) if self.tidy else 0
        self.paths: dict[int, str] = {}
        ship(spark)
        atexit.register(self.clear)

    def keep(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(self.cleanup, "false")
        if self.tidy:
            self.spark.conf.set(self.cleanup, "true")
        try:
            self.few(df).write.options(compression=codec or self.codec, **(self.plain if self.tidy else {})).parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(self.cleanup, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def few(self, df: DataFrame) -> DataFrame:
        """df in a tidy scratch's number of partitions, or two for each core if that is more; whole partitions join, so no row is sent."""
        return df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, self.files)) if self.tidy else df

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for df in frames:
            _delete(self.spark, self.paths.pop(id(df)))

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            _delete(self.spark, self.root)


def bytes_in(df: DataFrame) -> int:
    """Catalyst's estimate; very large where it has none."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever their names, are left out."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def mapped(df: DataFrame, run, more: str = "", inputs: int | None = None) -> DataFrame:
    """df.mapInArrow(run) for columns of any name, which run sees as c0, c1, ...; it yields the first `inputs` of them (all) and `more` (DDL)."""
    n = len(df.columns) if inputs is None else inputs
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields[:n]))
    out = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, kinds + (f", {more}" if more else ""))
    return out.toDF(*df.columns[:n], *out.columns[n:])


def row_key() -> F.Column:
    """Tells rows of (doc_id, text) apart, null-safe; repeated rows have the same."""
    return F.xxhash64("doc_id", "text")


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets everything when it gets large, so memory stays bounded."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_TABLE = mixed(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * MIX)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of the words that `data.split()` gives, without making them.

    A word's hash adds up a keyed number for each byte and place in the word; beyond 64 bytes the number
    is that of the place in its block times a keyed odd number of the block, so that no two places weigh alike.
    """
    x = np.frombuffer(data, np.uint8)
    space = _SPACES[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    place = np.arange(len(x)) - np.repeat(np.concatenate([[0], start[1:]]), np.diff(np.concatenate([[0], start[1:], [len(x)]])))
    place[: start[0]] = 0
    place[start[0] : end[0]] -= start[0]
    c = _TABLE[((place & 63) << 8) | x]
    if int((end - start).max()) > 64:
        far = np.flatnonzero(place >= 64)
        c[far] *= mixed((place[far] >> 6).astype(np.uint64) * MIX) | np.uint64(1)
    c[space] = 0
    return mixed(np.add.reduceat(c, start)), start, end


def bytes_of(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of words with hashes h; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * MIX + h[j : j + n]
    return mixed(out)


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a, b: long) as (id, root), root the least id.

    Every round points each node to the least of its neighbours and itself and contracts the graph
    along these pointers, which at least halves its nodes; then the pointers are followed
    from the last round back. Each round is a written table, so a lost executor costs one round, and
    nothing is collected but whether edges are left.
    """
    levels = []
    graph = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while graph.limit(1).count():
        both = graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")))
        levels.append(least)
        x, y = least.toDF("xi", "xt"), least.toDF("yi", "yt")
        moved = graph.join(x, F.col("a") == F.col("xi")).join(y, F.col("b") == F.col("yi")).where("xt <> yt")
        new = scratch.keep(moved.select(F.least("xt", "yt").alias("a"), F.greatest("xt", "yt").alias("b")).distinct())
        scratch.drop(graph)
        graph = new
    if not levels:
        return graph.select(F.col("a").alias("id"), F.col("b").alias("root"))
    root = levels.pop().select("id", F.col("to").alias("root"))
    for least in reversed(levels):
        above = root.toDF("ri", "rr")
        root = scratch.keep(least.join(above, F.col("to") == F.col("ri"), "left").select("id", F.coalesce("rr", "to").alias("root")))
    return root
