"""Queries on a change log: exact filters, the latest batch, pages, and checks of captured pages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QueryError

#: Record statuses that are known.
KNOWN_STATUS = (1, 2, 3, 4)


@dataclass
class LogQuery:
    """What is asked of the log. Column names of the log are those of the fields, plus push_id, record_id, unique_id, status."""

    product: str | None = None
    build: str | None = None
    region_id: int | None = None
    locale: str | None = None
    table_name: str | None = None
    table_hash: int | None = None
    record_id: int | None = None
    push_id: int | None = None
    start: datetime | None = None
    end: datetime | None = None
    latest: bool = False
    page: int = 0
    limit: int = 0

    def validate(self) -> LogQuery:
        for name in ("product", "build", "region_id", "locale"):
            if not getattr(self, name):
                raise QueryError("hotfix_invalid_query", f"{name} is required")
        if not self.latest and all(getattr(self, n) is None for n in ("table_name", "table_hash", "record_id", "push_id", "start", "end")):
            raise QueryError("hotfix_invalid_query", "a selector is required")
        if self.start and self.end and self.start > self.end:
            raise QueryError("hotfix_invalid_query", "start is after end")
        if self.page < 0 or self.limit < 0:
            raise QueryError("hotfix_invalid_query", "page and limit must not be negative")
        return self

    def conditions(self) -> list[Column]:
        same = [F.col(n) == getattr(self, n) for n in ("product", "region_id", "locale", "table_name", "table_hash", "record_id", "push_id") if getattr(self, n) is not None]
        if self.build:
            same.append(build_matches(F.col("build"), self.build))
        if self.start:
            same.append(F.col("created_at") >= self.start)
        if self.end:
            same.append(F.col("created_at") <= self.end)
        return same


def build_matches(column: Column, build: str) -> Column:
    """A full build, or its last part, on either side."""
    return (column == build) | F.endswith(column, F.lit(f".{build}")) | F.endswith(F.lit(build), F.concat(F.lit("."), column))


def latest_batch(df: DataFrame, push: str) -> DataFrame:
    """All rows with the greatest push; the maximum is aggregated on its own, without gathering the rows."""
    most = df.agg(F.max(push).alias("__most"))
    return df.join(most, F.col(push) == F.col("__most")).drop("__most")  # one row


def page(df: DataFrame, order: list[str], number: int, limit: int) -> DataFrame:
    """Page `number`, from 0, in a total order; without a limit all rows."""
    df = df.orderBy(*order)
    return df.offset(number * limit).limit(limit) if limit else df


def query(log: DataFrame, q: LogQuery) -> DataFrame:
    q.validate()
    out = log
    for c in q.conditions():
        out = out.where(c)
    if q.latest:
        out = latest_batch(out, "push_id")
    return page(out, ["push_id", "record_id", "unique_id"], q.page, q.limit)


def repeated_ids(captured: DataFrame, id_column: str) -> DataFrame:
    """(id, n) of ids that several captured pages carry."""
    return captured.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1")


def page_gaps(pages: DataFrame, number: str, stretch: int = 65_536) -> DataFrame:
    """(page, previous) where page numbers do not follow one another.

    Looked for within stretches of numbers; only the last number of each stretch is met in one order.
    """
    placed = pages.select(F.col(number).alias("page"), F.floor(F.col(number) / stretch).alias("stretch"))
    ends = placed.groupBy("stretch").agg(F.max("page").alias("end"))
    before = ends.select("stretch", F.lag("end").over(Window.orderBy("stretch")).alias("before"))  # a row for each stretch
    within = placed.withColumn("lag", F.lag("page").over(Window.partitionBy("stretch").orderBy("page")))
    return within.join(before, "stretch").select("page", F.coalesce("lag", "before").alias("previous")).where("page <> previous + 1")


def write_index(log: DataFrame, path: str, source: str) -> None:
    """A copy of a change log for point queries, sorted by table, record and push, with what its source was (`source`: any text
    that changes with the source, such as its length and time), so that a stale copy is noticed."""
    keys = ["table_hash", "record_id", "push_id"]
    log.withColumn("__source", F.lit(source)).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def point(spark: SparkSession, path: str, source: str, table_hash: int, record_id: int | None = None, push_id: int | None = None) -> DataFrame:
    """Rows of one table's record or push from an index; the scan skips what the sorted files' statistics rule out.

    A stale index is refused: its rows are not those of the source.
    """
    index = spark.read.parquet(path)
    found = index.select("__source").limit(1).first()
    if found is not None and found["__source"] != source:
        raise QueryError("hotfix_index_stale", f"{path} is of {found['__source']}, not of {source}")
    out = index.where(F.col("table_hash") == table_hash)
    for name, value in (("record_id", record_id), ("push_id", push_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.drop("__source")


def unknown_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(~F.col(status).isin(*KNOWN_STATUS))


def positional(payload: Column, names: list[str]) -> Column:
    """A JSON array's values under the names of their places."""
    values = F.from_json(payload, "array<string>")
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.slice(values, 1, len(names)))
