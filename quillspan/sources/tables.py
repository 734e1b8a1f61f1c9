"""Binary table snapshots (WDC2 to WDC5): columns are cut out of the record matrix with NumPy and leave as Arrow batches.

A file is one task; many files, such as the builds of a table, are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .dbd import Definition, Field

#: Magic numbers with their format version, and how a field may be stored.
VERSIONS = {b"WDC2": 2, b"1SLC": 2, b"WDC3": 3, b"WDC4": 4, b"WDC5": 5}
PLAIN, BITS, COMMON, INDEXED, INDEXED_ARRAY, SIGNED_BITS = range(6)

_HEADER = np.dtype([(n, "<u4") for n in ("records", "fields", "record_size", "strings", "table_hash", "layout_hash", "min_id", "max_id", "locale")] + [("flags", "<u2"), ("id_index", "<u2")] + [(n, "<u4") for n in ("all_fields", "bitpacked_at", "lookups", "storage_size", "common_size", "pallet_size", "sections")])
_SECTION = np.dtype([("key", "<u8")] + [(n, "<u4") for n in ("at", "records", "strings", "records_end", "ids", "relations", "offsets", "copies")])
_SECTION_2 = np.dtype([("key", "<u8")] + [(n, "<u4") for n in ("at", "records", "strings", "copies", "records_end", "ids", "relations")])
_STORAGE = np.dtype([("bit", "<u2"), ("size", "<u2"), ("extra", "<u4"), ("kind", "<u4"), ("a", "<u4"), ("b", "<u4"), ("c", "<u4")])
_PAIR = np.dtype([("key", "<u4"), ("value", "<u4")])
_SPAN = np.dtype([("at", "<u4"), ("size", "<u2")])


class Reader:
    """Takes arrays from a buffer one after the other; ValueError where it ends too soon."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, dtype, count: int) -> np.ndarray:
        size = np.dtype(dtype).itemsize * int(count)
        if self.at + size > len(self.data):
            raise ValueError(f"file ends at {len(self.data)}, inside a block from {self.at} to {self.at + size}")
        out = np.frombuffer(self.data, dtype, int(count), self.at)
        self.at += size
        return out


@dataclass
class Section:
    head: np.void
    records_at: int
    size: int
    strings_at: int
    ids: np.ndarray
    spans: np.ndarray
    relations: dict[int, int]
    locked: bool


@dataclass
class Snapshot:
    data: bytes
    version: int
    head: np.void
    storage: np.ndarray
    pallets: list[np.ndarray]
    commons: list[np.ndarray]
    sections: list[Section]
    copies: np.ndarray

    @property
    def sparse(self) -> bool:
        return bool(self.head["flags"] & 1)

    @property
    def layout(self) -> str:
        return f"{int(self.head['layout_hash']):08X}"


def _start(data: bytes) -> tuple[int, Reader, np.void]:
    version = VERSIONS.get(data[:4])
    if version is None:
        raise ValueError(f"no table: {data[:4]!r}")
    r = Reader(data)
    r.take("u1", 4 + 132 * (version == 5))
    return version, r, r.take(_HEADER, 1)[0]


def layout_of(head: bytes) -> str:
    """The layout hash that the first bytes of a file name."""
    return f"{int(_start(head)[2]['layout_hash']):08X}"


def parse(data: bytes) -> Snapshot:
    version, r, head = _start(data)
    heads = r.take(_SECTION_2 if version == 2 else _SECTION, head["sections"])
    r.take("<u4", head["all_fields"])
    storage = r.take(_STORAGE, int(head["storage_size"]) // _STORAGE.itemsize)
    blocks = {}
    for name, kinds, dtype in (("pallet", (INDEXED, INDEXED_ARRAY), np.dtype("<u4")), ("common", (COMMON,), _PAIR)):
        end = r.at + int(head[f"{name}_size"])
        blocks[name] = [r.take(dtype, s["extra"] // dtype.itemsize if s["kind"] in kinds else 0) for s in storage]
        r.take("u1", end - r.at)
    if version > 3 and r.at < len(data):
        for _ in range(len(heads) - 1):
            r.take("<u4", r.take("<u4", 1)[0])
    sparse = bool(head["flags"] & 1)
    sections, copies = [], [np.empty(0, _PAIR)]
    for h in heads:
        at = r.at
        size = int(h["records_end"]) - int(h["at"]) if sparse else int(head["record_size"]) * int(h["records"])
        body = r.take("u1", size)
        strings_at = r.at
        r.take("u1", h["strings"])
        if version == 2 and sparse:
            r.at = max(r.at, int(h["records_end"]))
            spans = r.take(_SPAN, int(head["max_id"]) - int(head["min_id"]) + 1)
        ids = r.take("<u4", h["ids"] // 4)
        copies.append(r.take(_PAIR, h["copies"] // 8 if version == 2 else h["copies"]))
        if version > 2:
            spans = r.take(_SPAN, h["offsets"])
            r.take("<u4", h["offsets"])  # the ids again
        elif not sparse:
            spans = np.empty(0, _SPAN)
        relations: dict[int, int] = {}
        if h["relations"]:
            end = r.at + int(h["relations"])
            count = r.take("<u4", 3)[0]
            pairs = r.take(_PAIR, count)
            relations = dict(zip(pairs["value"].tolist(), pairs["key"].tolist(), strict=True))
            r.at = end
        sections.append(Section(h, at, size, strings_at, ids, spans, relations, bool(h["key"]) and not body.any()))
    return Snapshot(data, version, head, storage, blocks["pallet"], blocks["common"], sections, np.concatenate(copies))


def _dtype(f: Field, kind: str) -> np.dtype:
    if kind == "float":
        return np.dtype("<f4")
    return np.dtype(f"<{'u' if f.unsigned else 'i'}{(f.bits or 32) // 8}")


def _packed(body: np.ndarray, bit: int, size: int) -> np.ndarray:
    """Bit fields at one place of every row of a byte matrix; a field lies within eight bytes."""
    first = bit >> 3
    window = np.zeros((len(body), 8), np.uint8)
    got = body[:, first : first + 8]
    window[:, : got.shape[1]] = got
    raw = window.view("<u8")[:, 0] >> np.uint64(bit & 7)
    return raw & np.uint64((1 << size) - 1) if size < 64 else raw


def _as(values: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """The low bytes of 64-bit values, read as dtype."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : dtype.itemsize].copy().view(dtype)[:, 0]


def _stored(s: Snapshot, i: int, body: np.ndarray, ids: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Values of a field that is not stored plainly: one a row, or a row of an array each."""
    info = s.storage[i]
    if info["kind"] == COMMON:
        own = dict(zip(s.commons[i]["key"].tolist(), s.commons[i]["value"].tolist(), strict=True))
        default = int(info["a"])
        return _as(np.array([own.get(x, default) for x in ids.tolist()], np.uint64), dtype)
    raw = _packed(body, int(info["bit"]), int(info["size"]))
    if info["kind"] in (INDEXED, INDEXED_ARRAY):
        width = int(info["c"]) if info["kind"] == INDEXED_ARRAY else 1
        padded = np.append(s.pallets[i], np.uint32(0))
        at = np.minimum(raw, len(padded)).astype(np.int64)[:, None] * width + np.arange(width)
        got = _as(padded[np.minimum(at, len(padded) - 1)].ravel(), dtype)
        return got.reshape(-1, width) if info["kind"] == INDEXED_ARRAY else got
    if info["kind"] == SIGNED_BITS and 0 < info["size"] < 64:
        shift = np.int64(64 - int(info["size"]))
        raw = ((raw.astype(np.int64) << shift) >> shift).astype(np.uint64)
    return _as(raw, dtype)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class _Strings:
    """The string blocks of all sections as one, which references count through."""

    def __init__(self, s: Snapshot):
        self.block = b"".join(s.data[x.strings_at : x.strings_at + int(x.head["strings"])] for x in s.sections)
        self.known: dict[int, str] = {}

    def get(self, at: int) -> str:
        if at not in self.known:
            end = self.block.find(b"\0", at)
            self.known[at] = _text(self.block[at : len(self.block) if end < 0 else end]) if 0 <= at < len(self.block) else ""
        return self.known[at]


def _inline(s: Snapshot, section: Section, fields: list[tuple[Field, str]], starts: list[int]) -> list[list]:
    """Plain fields of records whose strings stand inside them, read one after the other; None for fields stored otherwise."""
    columns: list[list] = [[] for _ in fields]
    limit = section.records_at + section.size
    for at in starts:
        for i, (f, kind) in enumerate(fields):
            if s.storage[i]["kind"] != PLAIN:
                continue
            if kind in ("string", "locstring"):
                texts = []
                for _ in range(max(f.length, 1)):
                    end = s.data.find(b"\0", at, limit)
                    end = limit if end < 0 else end
                    texts.append(_text(s.data[at:end]))
                    at = min(end + 1, limit)
                columns[i].append(texts if f.length else texts[0])
            else:
                d, n = _dtype(f, kind), max(f.length, 1)
                if at + d.itemsize * n > len(s.data):
                    raise ValueError(f"record ends inside field {f.name}")
                got = np.frombuffer(s.data, d, n, at)
                columns[i].append(got if f.length else got[0])
                at += d.itemsize * n
    return columns


def _section_columns(s: Snapshot, number: int, fields: list[tuple[Field, str]], strings: _Strings, id_name: str | None) -> tuple[np.ndarray, list]:
    """(record ids, a column for each inline field) of one section."""
    section = s.sections[number]
    n = int(section.head["records"])
    listed = section.ids[:n] if len(section.ids) >= n and section.ids.any() else None
    width = int(s.head["record_size"])
    ids = listed
    if s.sparse:
        if s.version == 2:
            place = np.flatnonzero(section.spans["size"])
            ids, spans = (place + int(s.head["min_id"])).astype(np.uint32), section.spans[place]
        else:
            spans = section.spans[:n]
        starts = spans["at"].tolist()
        longest = max((int(x["bit"]) + int(x["size"]) + 71 >> 3 for x in s.storage if x["kind"] != PLAIN), default=1)
        padded = np.frombuffer(s.data + bytes(longest), np.uint8)
        body = padded[np.array(starts, np.int64)[:, None] + np.arange(longest)] if starts else np.zeros((0, longest), np.uint8)
    else:
        body = np.frombuffer(s.data, np.uint8, section.size, section.records_at).reshape(n, width) if width else np.zeros((n, 0), np.uint8)
        starts = [section.records_at + k * width for k in range(n)]
    inline = _inline(s, section, fields, starts) if s.sparse or s.version == 2 else None
    before = sum(x.size for x in s.sections[:number]) - int(s.head["records"]) * width

    def column(i: int):
        f, kind = fields[i]
        info = s.storage[i]
        text = kind in ("string", "locstring")
        if info["kind"] != PLAIN:
            return [""] * len(body) if text else _stored(s, i, body, ids, _dtype(f, kind))
        if inline is not None:
            return inline[i] if text else np.array(inline[i], _dtype(f, kind)).reshape((-1, f.length) if f.length else (-1,))
        first = int(info["bit"]) >> 3
        d, m = (np.dtype("<u4"), max(f.length, 1)) if text else (_dtype(f, kind), max(f.length, 1))
        if first + d.itemsize * m > width:
            raise ValueError(f"field {f.name} leaves the record")
        got = np.ascontiguousarray(body[:, first : first + d.itemsize * m]).view(d)
        if text:
            base = before + np.arange(n, dtype=np.int64)[:, None] * width + first + 4 * np.arange(m) + got
            made = [["" if ref == 0 else strings.get(at) for ref, at in zip(a, b, strict=True)] for a, b in zip(got.tolist(), base.tolist(), strict=True)]
            return made if f.length else [x[0] for x in made]
        return got if f.length else got[:, 0]

    if ids is None:
        at = next((i for i, (f, _) in enumerate(fields) if f.name == id_name), int(s.head["id_index"]))
        ids = column(at).astype(np.uint32) if at < len(fields) else np.arange(n, dtype=np.uint32)
    return ids, [column(i) for i in range(len(fields))]


def _arrow(values, t: pa.DataType) -> pa.Array:
    if isinstance(values, list):
        return pa.array(values, t)
    if pa.types.is_list(t):
        flat = values.reshape(len(values), -1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, max(flat.shape[1], 1), dtype=np.int32)), _arrow(flat.ravel(), t.value_type))
    if values.ndim == 2:
        values = values[:, 0]
    if pa.types.is_decimal(t):
        return pa.array([Decimal(x) for x in values.tolist()], t)
    return pa.array(values).cast(t, safe=False)


def batches(data: bytes, fields: list[Field], kinds: dict[str, str], schema: pa.Schema, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
    """The rows of a file, section after section, then its copies. Locked sections are left out; a copy of a row that is not there too."""
    s = parse(data)
    marked = lambda f, mark: mark in f.marks and "noninline" in f.marks
    stored = [(f, kinds[f.name]) for f in fields if not (marked(f, "id") or marked(f, "relation"))]
    id_name = next((f.name for f in fields if "id" in f.marks), None)
    if len(stored) > len(s.storage):
        raise ValueError(f"{len(stored)} fields wanted, {len(s.storage)} stored")
    strings, tables = _Strings(s), []
    for k, section in enumerate(s.sections):
        if section.locked or not section.head["records"]:
            continue
        ids, columns = _section_columns(s, k, stored, strings, id_name)
        by_name = dict(zip((f.name for f, _ in stored), columns, strict=True))
        keys = ids.tolist() if s.sparse else range(len(ids))
        arrays = []
        for f, column in zip(fields, schema, strict=True):
            if f.name in by_name:
                values = by_name[f.name]
            elif marked(f, "id"):
                values = ids
            else:
                values = np.array([section.relations.get(x, 0) for x in keys], np.uint32)
            arrays.append(_arrow(values, column.type))
        tables.append((ids, pa.Table.from_arrays(arrays, schema=schema)))
    if not tables:
        return
    table = pa.concat_tables([t for _, t in tables])
    place = dict(zip(np.concatenate([i for i, _ in tables]).tolist(), range(table.num_rows), strict=True))
    copies = [(int(c["key"]), place[int(c["value"])]) for c in s.copies if c["key"] != c["value"] and int(c["value"]) in place]
    if copies:
        more = table.take(pa.array([at for _, at in copies]))
        if id_name:
            at = schema.get_field_index(id_name)
            more = more.set_column(at, schema.field(at), _arrow(np.array([new for new, _ in copies], np.uint32), schema.field(at).type))
        table = pa.concat_tables([table, more])
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def read_table(spark: SparkSession, path: str, definition: Definition, build: str | None = None) -> DataFrame:
    """The rows of the table files at path, which share one layout: that of the first file's header, else of the build."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select(F.substring("content", 1, 256).alias("head")).first()
    if first is None:
        raise ValueError(f"no file at {path}")
    version = definition.select(layout_of(bytes(first["head"])), build)
    if version is None:
        raise ValueError("schema_not_available")
    schema = definition.schema(version)
    for f in schema:
        f.nullable = True
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    arrow, fields, kinds = to_arrow_schema(plain), version.fields, definition.kinds

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("content"):
                yield from batches(data.as_py(), fields, kinds, arrow)

    out = files.select("content").mapInArrow(run, plain)
    return out.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema])
