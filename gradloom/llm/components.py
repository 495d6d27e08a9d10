"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a node are linked to the least of its neighbours and itself; small: those below it."""
    ends = _both(edges) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = ends.join(least, "u")  # a star's centre may be hot; a join's hot side is split at run time
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): ``edges`` (a long, b long) in any direction, loops and repeats allowed.

    The component is its least node.  Nodes without an edge don't appear; no edges give an empty table.
    """
    edges, mark = written(edges.where("a <> b").distinct(), "links"), None
    for _ in range(most_rounds):
        edges = written(_star(written(_star(edges, True), "links"), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == now:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        mark = now
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
