"""Connected components by alternating large and small stars, on DataFrames.

Every round joins each node to the smallest id among its neighbours; sums are
pre-aggregated and a node's neighbours are never gathered, so a node that
touches a third of the graph is only a skewed join key. Each round is staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.llm.base import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, turned towards the least neighbour of each node."""
    # a node's other ends: all of them, or only the smaller ones
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    turned = ends.join(least, ends["u"] == least["c"])
    if large:
        out = turned.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = turned.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): each id of ``edges`` (a, b) but the smallest of its component, with that smallest."""
    turned = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    turned, mark = staged(turned), None
    for _ in range(most_rounds):
        got = turned.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == mark or got[0] == 0:
            return turned.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = tuple(got)
        turned = staged(_star(_star(turned, True), False))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
