"""Lenient casts, arithmetic in doubles with NULL for zero divisors, and LIKE with `%` alone. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of types that a lenient cast knows, and the texts that are booleans.
TYPES = {"string": "string", "text": "string", "varchar": "string", "int": "bigint", "integer": "bigint", "bigint": "bigint", "float": "double", "double": "double", "real": "double", "bool": "boolean", "boolean": "boolean"}
TRUE, FALSE = ("1", "t", "true"), ("0", "f", "false")


def as_text(x: Column) -> Column:
    return x.cast("string")


def lenient_cast(x: Column, kind: str) -> Column:
    """NULL where the value or the type has no meaning; integers by truncation; whole doubles print without a fraction."""
    target = TYPES.get(kind.lower())
    if target is None:
        return F.lit(None).cast("string")
    if target == "boolean":
        low = F.lower(F.trim(x.cast("string")))
        return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    if target == "string":
        return F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0$", "$1")
    return x.try_cast(target)


def _double(x: Column) -> Column:
    return x.try_cast("double")


def add(a: Column, b: Column) -> Column:
    return _double(a) + _double(b)


def subtract(a: Column, b: Column) -> Column:
    return _double(a) - _double(b)


def multiply(a: Column, b: Column) -> Column:
    return _double(a) * _double(b)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(_double(a), _double(b))


def modulo(a: Column, b: Column) -> Column:
    """Truncated remainder, NULL for a zero divisor."""
    return _double(a) % F.nullif(_double(b), F.lit(0.0))


def like_percent(x: Column, pattern: str) -> Column:
    """LIKE in which only `%` is special."""
    return x.like(pattern.replace("\\", "\\\\").replace("_", "\\_"))


def contains_text(x: Column, query: str) -> Column:
    """Case-insensitive containment of literal text in any column."""
    return F.contains(F.lower(as_text(x)), F.lit(query.lower()))


def code_points(x: Column) -> Column:
    return F.length(as_text(x)).cast("bigint")
