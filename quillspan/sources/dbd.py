"""Table definitions in text: columns once, then versions with the builds and layouts that they hold for."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

Build = tuple[int, ...]
_COLUMN = re.compile(r"(?P<kind>\w+)(?:<(?P<table>\w+)::(?P<column>\w+)>)?\s+(?P<name>\w+)(?P<unsure>\?)?")
_FIELD = re.compile(r"(?:\$(?P<marks>[\w,]+)\$)?(?P<name>\w+)(?:<(?P<unsigned>u?)(?P<bits>\d+)>)?(?:\[(?P<length>\d+)\])?\s*(?://.*)?$")
#: Spark's type for signed and unsigned integers of each size.
SIGNED = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
UNSIGNED = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}


@dataclass
class Field:
    name: str
    bits: int = 0
    unsigned: bool = False
    length: int = 0
    marks: frozenset[str] = frozenset()


@dataclass
class Version:
    builds: list[Build] = field(default_factory=list)
    ranges: list[tuple[Build, Build]] = field(default_factory=list)
    layouts: set[str] = field(default_factory=set)
    fields: list[Field] = field(default_factory=list)


@dataclass
class Definition:
    kinds: dict[str, str]
    versions: list[Version]

    def select(self, layout: str | None = None, build: str | None = None) -> Version | None:
        """The version of a layout, else of the exact build, else of a range that holds it; the first of several."""
        if layout:
            for v in self.versions:
                if layout.upper() in v.layouts:
                    return v
        if build:
            b = parsed_build(build)
            for v in self.versions:
                if b in v.builds:
                    return v
            for v in self.versions:
                if any(low <= b <= high for low, high in v.ranges):
                    return v
        return None

    def schema(self, version: Version) -> T.StructType:
        """Spark's schema; id and relation columns carry their role."""
        out = T.StructType()
        for f in version.fields:
            kind = self.kinds.get(f.name)
            if kind in ("string", "locstring"):
                t: T.DataType = T.StringType()
            elif kind == "float":
                t = T.FloatType()
            elif kind == "int":
                sizes = UNSIGNED if f.unsigned else SIGNED
                if f.marks & {"id", "relation"} and "noninline" in f.marks:
                    t = T.LongType()
                elif f.bits in sizes:
                    t = sizes[f.bits]
                else:
                    raise ValueError(f"{f.name}: no integer of {f.bits} bits")
            else:
                raise ValueError(f"{f.name}: unknown type {kind}")
            role = next((r for r in ("id", "relation") if r in f.marks), None)
            out.add(f.name, T.ArrayType(t) if f.length else t, role != "id", {"role": role} if role else None)
        return out


def parsed_build(text: str) -> Build:
    return tuple(int(x) for x in text.strip().split("."))


def parse(text: str) -> Definition:
    """Lines that fit no rule are skipped."""
    kinds: dict[str, str] = {}
    versions: list[Version] = []
    current: Version | None = None
    in_columns = False
    for line in (x.strip() for x in text.splitlines()):
        word, _, rest = line.partition(" ")
        if not line:
            in_columns, current = False, None
        elif line == "COLUMNS":
            in_columns = True
        elif in_columns:
            if m := _COLUMN.match(line):
                kinds[m["name"]] = m["kind"]
        elif word == "COMMENT":
            continue
        elif word in ("BUILD", "LAYOUT"):
            if current is None or current.fields:
                current = Version()
                versions.append(current)
            for item in (x.strip() for x in rest.split(",")):
                if word == "LAYOUT":
                    current.layouts.add(item.upper())
                elif "-" in item:
                    low, _, high = item.partition("-")
                    current.ranges.append((parsed_build(low), parsed_build(high)))
                else:
                    current.builds.append(parsed_build(item))
        elif current is not None and (m := _FIELD.match(line)):
            current.fields.append(Field(m["name"], int(m["bits"] or 0), bool(m["unsigned"]), int(m["length"] or 0), frozenset((m["marks"] or "").split(",")) - {""}))
    return Definition(kinds, versions)
