"""Stable error codes over Spark's conditions."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException


class QueryError(Exception):
    """An error with a code that callers may rely on."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


#: Spark's condition, or the start of it, and our code.
CODES = {
    "TABLE_OR_VIEW_NOT_FOUND": "sql_unknown_table",
    "UNRESOLVED_COLUMN": "sql_unknown_column",
    "AMBIGUOUS_REFERENCE": "sql_ambiguous_column",
    "PARSE_": "sql_parse_error",
    "UNBOUND_SQL_PARAMETER": "sql_missing_parameter",
    "DATATYPE_MISMATCH": "sql_type_mismatch",
    "RECURSION_LEVEL_LIMIT_EXCEEDED": "sql_recursive_limit",
    "RECURSION_ROW_LIMIT_EXCEEDED": "sql_recursive_limit",
    "CATALOG_NOT_FOUND": "sql_unknown_catalog",
    "SCHEMA_NOT_FOUND": "sql_unknown_catalog",
    "UNSUPPORTED": "sql_unsupported_feature",
    "OPERATION_CANCELED": "sql_cancelled",
}


def translated(error: Exception) -> QueryError:
    """Our error for Spark's; actions raise plain Java errors, which are told by their message."""
    condition = (error.getCondition() if isinstance(error, PySparkException) else None) or ""
    text = str(error)
    if not condition and (m := re.search(r"\[([A-Z_.]+)\]", text)):
        condition = m[1]
    if "cancelled" in text and "Job" in text:
        return QueryError("sql_cancelled", text.splitlines()[0])
    if "OutOfMemory" in text:
        return QueryError("sql_memory_limit", text.splitlines()[0])
    for start, code in CODES.items():
        if condition.startswith(start):
            return QueryError(code, text.splitlines()[0])
    return QueryError("query_error", text.splitlines()[0] if text else type(error).__name__)
