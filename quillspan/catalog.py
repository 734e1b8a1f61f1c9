"""Tables by name: Parquet snapshots registered as views, with column roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROLE = "role"
ID, RELATION = "id", "relation"
#: The catalogue's own qualifier; `static.T` is `T`.
QUALIFIER = "static"

_schemas: dict[tuple[str, str], StructType] = {}


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """df with a role in the metadata of the named columns."""
    return df.select(*[F.col(f"`{c}`").alias(c, metadata={ROLE: roles[c]}) if c in roles else F.col(f"`{c}`") for c in df.columns])


def column_with(df: DataFrame, role: str) -> str | None:
    return next((f.name for f in df.schema if f.metadata.get(ROLE) == role), None)


@dataclass
class Catalog:
    """An immutable set of tables; `snapshot` fixes it, as DataFrames are plans over immutable files."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame, roles: dict[str, str] | None = None) -> Catalog:
        df = with_roles(df, roles or {})
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return self

    def add_parquet(self, folder: str, *names: str, roles: dict[str, dict[str, str]] | None = None) -> Catalog:
        """Snapshots do not change, so the schema of each is read once a session: reading it is a job of its own."""
        for name in names:
            path = f"{folder}/{name}.parquet"
            key = (self.spark.sparkContext.applicationId, path)
            if key not in _schemas:
                _schemas[key] = self.spark.read.parquet(path).schema
            self.add(name, self.spark.read.schema(_schemas[key]).parquet(path), (roles or {}).get(name))
        return self

    def table(self, name: str) -> DataFrame:
        return self.tables[name.removeprefix(f"{QUALIFIER}.")]

    def snapshot(self) -> Catalog:
        return Catalog(self.spark, dict(self.tables))

    def describe(self, *names: str) -> DataFrame:
        """(table_name, n_rows, n_columns), counted where the tables are."""
        parts = [self.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(self.table(n).columns)).cast("long").alias("n_columns")) for n in names or self.tables]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
