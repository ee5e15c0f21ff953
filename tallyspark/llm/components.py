"""Connected components by alternating large and small stars, one shuffle join a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v.  Large star: every greater neighbour to the least; small star: every lesser neighbour and the node itself."""
    if large:
        near = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        linked = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.where("u > v").distinct()


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """links (a, b) of ids to (id, component), the least id reachable, for every id but the least of each component."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, path = written(edges, "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.count_distinct("u")).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")), path
        seen = state
        moved, new = written(_star(_star(edges, True), False), "edges")
        removed(edges.sparkSession, path)
        edges, path = moved, new
