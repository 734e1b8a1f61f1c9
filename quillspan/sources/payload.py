"""Binary payloads of change-log records, read by a table's definition."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .dbd import Definition, Version

MOST_TEXT = 1 << 20


class SchemaMismatch(ValueError):
    """Carries the stable code of the contract."""

    code = "hotfix_schema_mismatch"


def values(data: bytes, version: Version, kinds: dict[str, str]) -> dict[str, object]:
    """The fields of a payload in the definition's order: little-endian numbers, and texts after their length."""
    out: dict[str, object] = {}
    at = 0

    def take(n: int, name: str) -> bytes:
        nonlocal at
        if n > len(data) - at:
            raise SchemaMismatch(f"{name}: {n} bytes wanted at {at} of {len(data)}")
        at += n
        return data[at - n : at]

    for f in version.fields:
        kind, found = kinds[f.name], []
        for _ in range(max(f.length, 1)):
            if kind == "float":
                found.append(struct.unpack("<f", take(4, f.name))[0])
            elif kind == "int":
                found.append(int.from_bytes(take((f.bits or 32) // 8, f.name), "little", signed=not f.unsigned))
            else:
                size = int.from_bytes(take(4, f.name), "little")
                if size > MOST_TEXT:
                    raise SchemaMismatch(f"{f.name}: a text of {size} bytes")
                found.append(take(size, f.name).decode("utf-8", "replace"))
        out[f.name] = found if f.length else found[0]
    return out


def decoded(rows: DataFrame, definition: Definition, build: str, payload: str = "raw_data") -> DataFrame:
    """rows with `values`, a struct of the payload's fields; null for no payload, and `error` for one that does not fit."""
    version = definition.select(None, build)
    if version is None:
        raise ValueError("schema_not_available")
    schema = definition.schema(version)
    kind = pa.struct(list(to_arrow_schema(schema)))
    place, names = rows.columns.index(payload), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for data in batch.column(place):
                data = data.as_py()
                try:
                    found.append(values(data, version, definition.kinds) if data else None)
                    errors.append(None)
                except SchemaMismatch as e:
                    found.append(None)
                    errors.append(f"{e.code}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], [*names, "values", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, values {schema.simpleString()}, error string")
