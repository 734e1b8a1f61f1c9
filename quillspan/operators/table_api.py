"""The typed table interface: the same engine without SQL text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import ID, RELATION, column_with
from ..errors import QueryError
from ..functions import contains_text
from ..sql import stream


def parsed_filter(df: DataFrame, text: str) -> Column:
    """`field=value` as a condition that the scan can take: the value is read as the column's type; one that is none matches nothing."""
    name, sign, value = text.partition("=")
    if not sign or name.strip() not in df.columns:
        raise QueryError("sql_invalid_input", text)
    return F.col(f"`{name.strip()}`") == F.lit(value.strip()).try_cast(df.schema[name.strip()].dataType)


def scan(df: DataFrame, fields: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    out = df.select(*[F.col(f"`{f}`") for f in fields]) if fields else df
    return out if limit is None else out.limit(limit)


def rows(df: DataFrame, ids: Sequence[int] = (), fields: Sequence[str] = (), where: str | None = None, limit: int | None = None, id_column: str | None = None) -> DataFrame:
    """Rows with one of the ids and the filter."""
    key = id_column or column_with(df, ID)
    if ids:
        df = df.where(F.col(key).isin(*ids))
    if where:
        df = df.where(parsed_filter(df, where))
    return scan(df, fields, limit)


def lookup(df: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """Rows for wanted(ord, id) in the order asked, repeated as often as asked; ids without a row are left out."""
    return wanted.join(df, wanted["id"] == df[id_column]).drop(wanted["id"])


def relationship(df: DataFrame, values: Sequence[int], column: str | None = None) -> DataFrame:
    """Rows whose relation column has one of the values."""
    return df.where(F.col(column or column_with(df, RELATION)).isin(*values))


def search(df: DataFrame, field_: str, query: str, limit: int | None = None) -> DataFrame:
    return scan(df.where(contains_text(F.col(f"`{field_}`"), query)), limit=limit)


def schema(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def expand_copies(base: DataFrame, copies: DataFrame, id_column: str) -> DataFrame:
    """base and, for each copies(dest, src), the row src again under the id dest."""
    again = base.join(copies, F.col(id_column) == F.col("src")).withColumn(id_column, F.col("dest")).select(base.columns)
    return base.unionByName(again)


@dataclass
class TableQuery:
    """A plan in one of five modes: rows, search, foreign_key, schema, stream."""

    table: DataFrame
    mode: str = "rows"
    ids: Sequence[int] = ()
    fields: Sequence[str] = ()
    where: str | None = None
    column: str | None = None
    value: str | int | None = None
    limit: int | None = None
    stats: dict[str, int] = field(default_factory=dict)

    def frame(self) -> DataFrame:
        if self.mode == "search":
            return scan(search(self.table, self.column, str(self.value)), self.fields, self.limit)
        if self.mode == "foreign_key":
            return scan(relationship(self.table, [self.value], self.column), self.fields, self.limit)
        if self.mode in ("rows", "stream"):
            return rows(self.table, self.ids, self.fields, self.where, self.limit, self.column)
        raise QueryError("sql_invalid_input", self.mode)

    def run(self) -> Iterator:
        if self.mode == "schema":
            yield from schema(self.table).items()
            return
        for row in stream(self.frame()):
            self.stats["rows"] = self.stats.get("rows", 0) + 1
            yield row
