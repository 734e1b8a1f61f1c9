"""Trees in node tables: paths, pre-order, first occurrences."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def child_edges(nodes: DataFrame) -> DataFrame:
    """(parent, child, ord) of nodes(id, parent, first_child, next_sibling, ord).

    A node with a first child has the children of its sibling chain, which a repeated node ends;
    any other node has those that name it as parent, in order of (ord, id).
    """
    chained = nodes.sparkSession.sql("""
        WITH RECURSIVE chain(parent, child, nth, path) MAX RECURSION LEVEL 1000 AS (
          SELECT id, first_child, 0, array(first_child) FROM {nodes} WHERE first_child <> 0
          UNION ALL
          SELECT c.parent, n.next_sibling, c.nth + 1, array_append(c.path, n.next_sibling)
          FROM chain c JOIN {nodes} n ON n.id = c.child
          WHERE n.next_sibling <> 0 AND NOT array_contains(c.path, n.next_sibling))
        SELECT parent, child, nth AS ord FROM chain""", nodes=nodes)
    plain = nodes.where("parent <> 0").join(nodes.where("first_child <> 0").select(F.col("id").alias("parent")), "parent", "left_anti")
    w = Window.partitionBy("parent").orderBy("ord", "id")
    return chained.select("parent", "child", "ord").unionByName(plain.select("parent", F.col("id").alias("child"), (F.row_number().over(w) - 1).alias("ord")))


def paths(roots: DataFrame, edges: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(id, depth, path) from roots(id, ord) along edges(parent, child, ord); path is an array whose order is pre-order.

    A level at a time, each a written table, so a tree may have any number of nodes; a node above itself ends its path.
    """
    # places are shifted to be positive, so that text order is their order
    step = lambda o, i: F.concat(F.lpad((o.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string"), 20, "0"), F.lit("/"), F.lpad(i.cast("string"), 19, "0"))
    edges = written(edges.select("parent", "child", "ord"))
    level = written(roots.select("id", F.lit(0).alias("depth"), F.array(step(F.col("ord"), F.col("id"))).alias("path"), F.array("id").alias("seen")))
    out = level
    for depth in range(1, max_depth + 1):
        below = level.join(edges, F.col("id") == F.col("parent")).where(~F.array_contains("seen", F.col("child")))
        level = written(below.select(F.col("child").alias("id"), F.lit(depth).alias("depth"), F.array_append("path", step(F.col("ord"), F.col("child"))).alias("path"), F.array_append("seen", F.col("child")).alias("seen")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("id", "depth", "path")


def preorder_first(walked: DataFrame, key: str) -> DataFrame:
    """The first row of each key in pre-order, aggregated before it is shuffled; rows with key 0 or NULL are no occurrence."""
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in walked.columns]), "path").alias("row")
    return walked.where(F.col(key) != 0).groupBy(F.col(key).alias("__key")).agg(row).select("row.*")
