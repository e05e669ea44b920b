"""Designs and flows as geometry features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.functions import wkb


def design_features(tables: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """(kind, a, b, value, geometry): hub and poi points, cable and drop lines. Raises if a point has no hub."""
    at = nodes.select("node", "lon", "lat")
    leaves = tables["assignment"].select(F.col("node").alias("leaf")).distinct()
    if not tables["assignment"].filter("hub is null").isEmpty():
        raise ValueError("a point has no hub")
    hubs = tables["hubs"].join(at, F.col("hub") == F.col("node")).select(F.lit("hub").alias("kind"), F.col("hub").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("value"), wkb.point("lon", "lat").alias("geometry"))
    pois = tables["assignment"].join(at, "node").select(F.lit("poi").alias("kind"), F.col("node").alias("a"), F.col("hub").alias("b"), F.lit(None).cast("double").alias("value"), wkb.point("lon", "lat").alias("geometry"))
    ends = at.select(F.col("node").alias("u"), F.col("lon").alias("x0"), F.col("lat").alias("y0")), at.select(F.col("node").alias("v"), F.col("lon").alias("x1"), F.col("lat").alias("y1"))
    used = tables["used_edges"].join(ends[0], "u").join(ends[1], "v")
    for end in ("u", "v"):
        used = used.join(leaves.select(F.col("leaf").alias(end), F.lit(True).alias(f"leaf_{end}")), end, "left")
    kind = F.when(F.col("leaf_u") | F.col("leaf_v"), "drop").otherwise("cable")
    lines = used.select(kind.alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("load").alias("value"), wkb.segment("x0", "y0", "x1", "y1").alias("geometry"))
    return hubs.unionByName(pois).unionByName(lines)


def flow_features(flow: DataFrame, arcs: DataFrame, nodes: DataFrame, n_static: int, least: float = 1e-9) -> DataFrame:
    """(kind, a, b, value, geometry): flow per street over layers and directions, and waiting per node.

    Arcs carry their origin, so overflow and relief arcs are exported too.
    """
    at = nodes.select("node", "lon", "lat")
    some = flow.filter(F.col("flow") > least).join(arcs.select("arc_id", "src_node", "dst_node", "origin"), "arc_id")
    some = some.withColumns({"p": F.col("src_node") % n_static, "q": F.col("dst_node") % n_static})
    kind = F.when(F.col("origin") == "wait", "wait").when(F.col("origin") == "relief", "unserved").otherwise("street_flow")
    each = some.groupBy(kind.alias("kind"), F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("flow").alias("value"))
    each = each.join(at.select(F.col("node").alias("a"), F.col("lon").alias("x0"), F.col("lat").alias("y0")), "a")
    each = each.join(at.select(F.col("node").alias("b"), F.col("lon").alias("x1"), F.col("lat").alias("y1")), "b")
    shape = F.when(F.col("a") == F.col("b"), wkb.point("x0", "y0")).otherwise(wkb.segment("x0", "y0", "x1", "y1"))
    return each.select("kind", "a", "b", "value", shape.alias("geometry"))


def checked_cost(flow: DataFrame, arcs: DataFrame, upper: float, tolerance: float = 1e-9) -> float:
    """Cost of a flow; raises if it isn't the bound it is said to attain."""
    cost = flow.join(arcs.select("arc_id", "cost"), "arc_id").agg(F.sum(F.col("flow") * F.col("cost"))).first()[0] or 0.0
    if abs(cost - upper) > tolerance * max(1.0, abs(upper)):
        raise ValueError(f"the flow costs {cost}, not {upper}")
    return cost
