"""Content manifests: root blocks, encoding pages and archive indexes, as the tables that `operators.files.resolved` joins.

Fixed-size parts are cut with NumPy and leave a block or page at a time, so that a manifest of millions of entries streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The root's magic number, and the flag of blocks without name hashes.
ROOT_MAGIC, NO_NAME_HASH = b"TSFM", 0x10000000

ROOT = pa.schema([("file_data_id", pa.int64()), ("ckey", pa.string()), ("locale_flags", pa.int64()), ("content_flags", pa.int64()), ("ord", pa.int64())])
ENCODING = pa.schema([("ckey", pa.string()), ("ekey", pa.string()), ("size", pa.int64())])
INDEX = pa.schema([("ekey", pa.string()), ("archive", pa.string()), ("length", pa.int64()), ("offset", pa.int64())])
_TYPES = {pa.int64(): "long", pa.string(): "string"}


def _hex(keys: np.ndarray) -> pa.Array:
    """Rows of bytes as lowercase hexadecimal text."""
    n = keys.shape[1]
    text = keys.tobytes().hex()
    return pa.array([text[i : i + 2 * n] for i in range(0, len(text), 2 * n)], pa.string())


def _cut(data: bytes, dtype, count: int, at: int) -> tuple[np.ndarray, int]:
    end = at + np.dtype(dtype).itemsize * count
    if end > len(data):
        raise ValueError(f"block from {at} to {end} leaves the file of {len(data)} bytes")
    return np.frombuffer(data, dtype, count, at), end


def root_blocks(data: bytes, name: str = "") -> Iterator[pa.RecordBatch]:
    """(file_data_id, ckey, locale_flags, content_flags, ord): ids are running sums of their gaps."""
    at, version, named, interleaved = 0, 0, True, True
    if data[:4] == ROOT_MAGIC:
        (first, second, third, fourth), _ = _cut(data, "<u4", 4, 4)
        interleaved = False
        if first == 0x18:
            version, files, hashed, at = int(second), third, fourth, 0x18
            if version not in (1, 2):
                raise ValueError(f"root version {version} is unknown")
        else:
            files, hashed, at = first, second, 12
        named = files == hashed
    ord = 0
    while at + 4 <= len(data):
        (n,), at = _cut(data, "<u4", 1, at)
        n = int(n)
        if version == 2:
            (locale, low, high), at = _cut(data, "<u4", 3, at)
            (top,), at = _cut(data, "u1", 1, at)
            content = int(low) | int(high) | int(top) << 17
        else:
            (content, locale), at = _cut(data, "<u4", 2, at)
        gaps, at = _cut(data, "<i4", n, at)
        keys, at = _cut(data, "u1", n * (24 if interleaved else 16), at)
        if not interleaved and (named or not int(content) & NO_NAME_HASH):
            _, at = _cut(data, "<u8", n, at)
        if n:
            ids = (np.cumsum(gaps.astype(np.int64) + 1) - 1) & 0xFFFFFFFF
            yield pa.RecordBatch.from_arrays([pa.array(ids), _hex(keys.reshape(n, -1)[:, :16]), pa.array(np.full(n, int(locale))), pa.array(np.full(n, int(content))), pa.array(np.arange(ord, ord + n))], schema=ROOT)
        ord += n


def encoding_pages(data: bytes, name: str = "") -> Iterator[pa.RecordBatch]:
    """(ckey, ekey, size) of an unpacked encoding table: the first encoding key of each content key."""
    if data[:2] != b"EN" or len(data) < 22:
        raise ValueError("no encoding table")
    ckey, ekey = data[3], data[4]
    page, pages, texts = int.from_bytes(data[5:7]) * 1024, int.from_bytes(data[9:13]), int.from_bytes(data[18:22])
    start = 22 + texts + pages * (ckey + 16)
    if start > len(data):
        raise ValueError("page index leaves the file")
    for p in range(pages):
        at, end = start + p * page, min(start + (p + 1) * page, len(data))
        found = []
        while at < end and data[at]:
            last = at + 6 + ckey + ekey * data[at]
            if last > end:
                raise ValueError(f"entry at {at} leaves its page")
            found.append((data[at + 6 : at + 6 + ckey].hex(), data[at + 6 + ckey : at + 6 + ckey + ekey].hex(), int.from_bytes(data[at + 1 : at + 6])))
            at = last
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=ENCODING)


def index_entries(data: bytes, name: str = "") -> Iterator[pa.RecordBatch]:
    """(ekey, archive, length, offset) of an archive's index; the archive is the file's name. Zero keys, which fill pages up, are stepped over."""
    if len(data) < 12:
        return
    count = int.from_bytes(data[-12:-8], "little")
    archive = name.rstrip("/").rpartition("/")[2].removesuffix(".index")
    found, at = [], 0
    while len(found) < count and at + 24 <= len(data):
        if not any(data[at : at + 16]):
            at += 16
            continue
        found.append((data[at : at + 16].hex(), archive, int.from_bytes(data[at + 16 : at + 20], signed=True), int.from_bytes(data[at + 20 : at + 24], signed=True)))
        at += 24
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=INDEX)


def _read(spark: SparkSession, path: str, parse: Callable[[bytes, str], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from parse(data.as_py(), name)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ", ".join(f"{f.name} {_TYPES[f.type]}" for f in schema))


def read_root(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, root_blocks, ROOT)


def read_encoding(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, encoding_pages, ENCODING)


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, index_entries, INDEX)
