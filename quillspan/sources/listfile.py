"""Path catalogues in text: a line `id;path` each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame) -> DataFrame:
    """(file_data_id, path, ord) of lines(ord, value): blank lines, comments and bad ids are skipped; an id's last line gives its path, its first its place."""
    part = F.split(F.trim("value"), ";", 2)
    got = lines.where(~F.trim("value").startswith("#")).select(part[0].try_cast("bigint").alias("file_data_id"), F.get(part, F.lit(1)).alias("path"), "ord").where("file_data_id is not null and path is not null")
    return got.groupBy("file_data_id").agg(F.max_by("path", "ord").alias("path"), F.min("ord").alias("ord"))


def read_listfile(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a text file; places follow the file."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), "value")
    return parse_lines(lines)
