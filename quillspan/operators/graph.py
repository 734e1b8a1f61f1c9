"""Bounded closure over edges, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written


def typed_edges(parts: list[DataFrame]) -> DataFrame:
    """Distinct edges (src, dst) of several sources, without loops."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src <> dst").distinct()


def text_edges(docs: DataFrame, id_column: str, text: Column, pattern: str, groups: tuple[int, ...] = (1,)) -> DataFrame:
    """Edges (src, ref) to what a pattern's groups find in a text."""
    found = F.array_union(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in groups]) if len(groups) == 2 else F.regexp_extract_all(text, F.lit(pattern), F.lit(groups[0]))
    return docs.select(F.col(id_column).alias("src"), F.explode(found).alias("ref")).where("ref <> ''").distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, int]:
    """((node, depth) with the least depth of each node reached, number of levels processed).

    A level is processed even if it finds nothing new; at most max_depth are. Edges are worked out once and
    written; each level joins only the nodes found last, and drops those known already.
    """
    edges = written(edges.select("src", "dst"))
    known = written(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, levels = known, 0
    while levels < max_depth and not frontier.isEmpty():
        levels += 1
        new = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = written(new.join(known, "node", "left_anti").withColumn("depth", F.lit(levels)))
        known = known.union(frontier)
    return known, levels


def reverse_edges(edges: DataFrame) -> DataFrame:
    """(node, n_sources, sources): who points to a node, in order."""
    return edges.distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_sources"), F.concat_ws(",", F.transform(F.sort_array(F.collect_set("src")), lambda x: x.cast("string"))).alias("sources"))


def level_rows(spark: SparkSession, levels: int) -> DataFrame:
    return spark.range(1).select(F.lit(levels).cast("long").alias("levels"))
