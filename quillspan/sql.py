"""The SQL front end: Spark's parser, with strict named parameters, checks that Spark lacks, and stable error codes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from .catalog import QUALIFIER
from .errors import QueryError, translated

_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_NAME = re.compile(r"(?<![:\w]):([A-Za-z_]\w*)")
_QUALIFIED = re.compile(r"\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)\.([A-Za-z_]\w*)", re.I)
_WRITES = re.compile(r"^\s*(?:INSERT|UPDATE|DELETE|MERGE|CREATE|DROP|ALTER|TRUNCATE|SET|USE|REFRESH|CACHE)\b", re.I)
#: Statements that the reference dialect rejects by name; here they run.
EXTENSIONS = ("RIGHT JOIN", "FULL JOIN", "UNION", "INTERSECT", "EXCEPT", "window functions", "correlated subqueries")


def parameter_names(text: str) -> set[str]:
    return set(_NAME.findall(_SKIP.sub(" ", text)))


def inferred(text: str) -> Any:
    """A parameter's value from its text: null, boolean, integer, float, quoted string, else string."""
    low = text.strip().lower()
    if low == "null":
        return None
    if low in ("true", "t", "1", "false", "f", "0"):
        return low in ("true", "t", "1")
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def checked(text: str, params: dict[str, Any]) -> str:
    """The text with the catalogue's qualifier removed; raises on what Spark would let pass."""
    bare = _SKIP.sub(" ", text)
    if not bare.strip():
        raise QueryError("sql_parse_error", "empty query")
    if _WRITES.match(bare):
        raise QueryError("sql_unsupported_feature", "only queries are allowed")
    for qualifier, _ in _QUALIFIED.findall(bare):
        if qualifier.lower() != QUALIFIER:
            raise QueryError("sql_unknown_catalog", qualifier)
    names = parameter_names(text)
    if missing := sorted(names - set(params)):
        raise QueryError("sql_missing_parameter", ", ".join(missing))
    if extra := sorted(set(params) - names):
        raise QueryError("sql_unknown_parameter", ", ".join(extra))
    return re.sub(rf"\b{QUALIFIER}\.", "", text, flags=re.I)


def run_sql(spark: SparkSession, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The query's DataFrame. Values are bound by Spark, never pasted into the text."""
    text = checked(text, params or {})
    try:
        return spark.sql(text, args=params or {})
    except Exception as error:
        raise translated(error) from error


def collected(df: DataFrame) -> list[Row]:
    """All rows, with errors at run time translated as well."""
    try:
        return df.collect()
    except Exception as error:
        raise translated(error) from error


def stream(df: DataFrame, limit: int | None = None) -> Iterator[Row]:
    """Rows one after the other, a partition at a time on the driver."""
    try:
        yield from (df if limit is None else df.limit(limit)).toLocalIterator(prefetchPartitions=True)
    except Exception as error:
        raise translated(error) from error


def explain(spark: SparkSession, text: str, params: dict[str, Any] | None = None, analyze: bool = False) -> DataFrame:
    """(line_no, line) of the formatted plan; with analyze, of the plan after it ran."""
    df = run_sql(spark, text, params)
    if analyze:
        df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return spark.createDataFrame(list(enumerate(plan.splitlines())), "line_no long, line string")


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends running queries that carry the tag (spark.addTag)."""
    spark.interruptTag(tag)
