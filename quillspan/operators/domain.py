"""Lookups over several tables: defaults, first and last rows, chains, exploded arrays, flags."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_element(x: Column, is_array: bool) -> Column:
    """A scalar from a column that may be an array: its first element."""
    return F.try_element_at(x, F.lit(1)) if is_array else x


def positive(x: Column) -> Column:
    """The positive elements of an array."""
    return F.filter(x, lambda v: v > 0)


def named(x: Column, names: dict, default: Column) -> Column:
    """A fixed map's value, or the default."""
    return F.coalesce(F.create_map(*[F.lit(v) for v in chain(*names.items())])[x], default)


def with_default(df: DataFrame, dim: DataFrame, on: Column, columns: dict[str, Column]) -> DataFrame:
    """df with columns of a dimension that may lack the row."""
    return df.join(dim, on, "left").withColumns(columns)


def first_by(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def last_value(df: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """(key, name): the value of the key's last row; aggregates before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(name))


def has_any(df: DataFrame, key: str, condition: Column, name: str) -> DataFrame:
    """(key, name): whether any row of the key fulfils the condition."""
    return df.groupBy(key).agg(F.bool_or(condition).alias(name))


def gathered(df: DataFrame, key: str, value: Column, order: Sequence[Column], name: str) -> DataFrame:
    """(key, name): the values of each key in order, as text joined by commas."""
    pairs = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.cast("string").alias("v"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), ",").alias(name))


def candidates(df: DataFrame, key: str, array: str, dim: DataFrame, dim_key: str, value: str) -> DataFrame:
    """(key, pos, value): for each element of an array the least candidate of a dimension; elements without one are dropped."""
    least = dim.groupBy(F.col(dim_key).alias("__k")).agg(F.min(value).alias(value))
    return df.select(key, F.posexplode(array).alias("pos", "__e")).join(least, F.col("__e") == F.col("__k")).select(key, "pos", value)


def variation(index: Column, value: Column) -> Column:
    return (index + 1) * 100 + value


def resolve_name(df: DataFrame, name: str, query: str) -> DataFrame:
    """The row with this name (case and outer spaces aside), else the first that contains it, by (length, name)."""
    q = query.strip().lower()
    low = F.lower(F.trim(F.col(name)))
    return df.where(F.contains(low, F.lit(q))).orderBy(F.when(low == q, 0).otherwise(1), F.length(name), name).limit(1)


def nth_child(df: DataFrame, key: str, order: Sequence[str], n: int) -> DataFrame:
    """The n-th row (from 1) of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") == n)
