"""Binary change logs, versions 1 to 9: one row a record, ready for `operators.changelog`."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"XFTH"
#: The fields of a record's header after its magic number, by version (x: four bytes without meaning).
HEADERS = {
    **dict.fromkeys((1,), "push size table record status"),
    **dict.fromkeys((2, 3, 4, 5, 6), "x push size table record status"),
    7: "push table record size status",
    8: "push unique table record size status",
    9: "region push unique table record size status",
}
CODES = {"x": "4x", "push": "i", "size": "i", "status": "B3x"}
SCHEMA = "path string, build long, region_id long, push_id int, unique_id long, table_hash long, record_id long, status short, raw_data binary"
_ARROW = pa.schema([("path", pa.string()), ("build", pa.int64()), ("region_id", pa.int64()), ("push_id", pa.int32()), ("unique_id", pa.int64()), ("table_hash", pa.int64()), ("record_id", pa.int64()), ("status", pa.int16()), ("raw_data", pa.binary())])


class CorruptLog(ValueError):
    """Carries the stable code of the contract."""

    code = "hotfix_corrupt_cache"


def _walk(data: bytes, at: int, version: int) -> Iterator[dict]:
    names = HEADERS[version].split()
    head = struct.Struct("<4s" + "".join(CODES.get(n, "I") for n in names))
    names = [n for n in names if n != "x"]
    while at < len(data):
        if at + head.size > len(data):
            raise CorruptLog(f"header is cut short at {at}")
        magic, *values = head.unpack_from(data, at)
        row = dict(zip(names, values, strict=True))
        begin, size = at + head.size, row["size"]
        if magic != MAGIC or not 0 <= size <= len(data) - begin:
            raise CorruptLog(f"no record at {at}")
        if version < 7:
            row["status"] = int(row["status"] != 0)
        yield row | {"raw": data[begin : begin + size]}
        at = begin + size


def records(data: bytes) -> tuple[int, Iterator[dict] | list[dict]]:
    """(build, records) of a log; version 8 may have the records of version 7, which then are the ones that fit to the end."""
    if len(data) < 12 or data[:4] != MAGIC:
        raise CorruptLog("no change log")
    version, build = struct.unpack_from("<Ii", data, 4)
    if version not in HEADERS:
        raise CorruptLog(f"version {version} is unknown")
    start = 44 if version >= 5 else 12
    if len(data) < start:
        raise CorruptLog("file header is cut short")
    if version == 8:
        try:
            return build, list(_walk(data, start, 8))
        except CorruptLog:
            return build, list(_walk(data, start, 7))
    return build, _walk(data, start, version)


def read_log(spark: SparkSession, path: str, rows: int = 10_000) -> DataFrame:
    """The records of the logs at path. Filters on table, record or push belong on a Parquet copy sorted by these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                build, found = records(data.as_py())
                held: list[dict] = []
                for r in found:
                    held.append({"path": name, "build": build, "region_id": r.get("region"), "push_id": r["push"], "unique_id": r.get("unique"), "table_hash": r["table"], "record_id": r["record"], "status": r["status"], "raw_data": r["raw"]})
                    if len(held) == rows:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
