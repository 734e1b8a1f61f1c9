"""Result envelopes and row formats."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import mimetypes
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .errors import QueryError
from .sql import collected, stream


def envelope(command: str, data: Any = None, warnings: list[str] | None = None, error: QueryError | None = None) -> dict[str, Any]:
    out = {"ok": error is None, "command": command, "data": data, "warnings": warnings or []}
    return out | ({"error": {"code": error.code, "message": error.message}} if error else {})


def exit_code(result: dict[str, Any]) -> int:
    return 0 if result["ok"] else 1


def to_json(command: str, df: DataFrame) -> str:
    """One envelope for all rows; for results that a driver can hold."""
    try:
        return json.dumps(envelope(command, [r.asDict(True) for r in collected(df)]), default=str, ensure_ascii=False)
    except QueryError as error:
        return json.dumps(envelope(command, error=error))


def to_jsonl(command: str, df: DataFrame) -> Iterator[str]:
    """One envelope for each row, streamed."""
    for row in stream(df):
        yield json.dumps(envelope(command, row.asDict(True)), default=str, ensure_ascii=False)


def to_csv(df: DataFrame) -> Iterator[str]:
    """A header and then rows, streamed; NULL is empty."""
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    for values in _rows(df):
        writer.writerow(["" if v is None else v for v in values])
        yield buffer.getvalue()
        buffer.seek(0)
        buffer.truncate()


def _rows(df: DataFrame) -> Iterator[Any]:
    yield df.columns
    yield from stream(df)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV written by the executors."""
    df.write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_file(data: bytes, path: str) -> dict[str, Any]:
    """Writes one object and says what it is."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)
    return {"path": str(target), "uri": target.resolve().as_uri(), "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "mime": mimetypes.guess_type(target.name)[0] or "application/octet-stream"}
