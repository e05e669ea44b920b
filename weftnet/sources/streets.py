"""Street import: road segments to a connected street graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftnet.functions import geo
from weftnet.operators.graph import largest_component
from weftnet.plans.staging import stage

#: fixed values: classes for people on foot, left out unless others are named
ON_FOOT = ("bridleway", "footway", "path", "steps")


def judged(segments: DataFrame, excluded: Sequence[str] = ON_FOOT, bbox: tuple | None = None, digits: int = 7) -> DataFrame:
    """``segments`` (subtype, class, points) with ends, len_m and reason: null if a segment is kept."""
    first, last = F.get("points", F.lit(0)), F.get("points", F.size("points") - 1)
    rows = segments.withColumns({"x0": F.round(first["lon"], digits), "y0": F.round(first["lat"], digits), "x1": F.round(last["lon"], digits), "y1": F.round(last["lat"], digits)})
    inside = F.lit(True)
    if bbox:
        a, b, c, d = bbox
        inside = first["lon"].between(a, c) & first["lat"].between(b, d) & last["lon"].between(a, c) & last["lat"].between(b, d)
    reason = (
        F.when(F.coalesce(F.col("subtype"), F.lit("")) != "road", F.concat(F.lit("subtype:"), F.coalesce("subtype", F.lit("None"))))
        .when(F.col("class").isin(*excluded), F.concat(F.lit("class:"), F.col("class")))
        .when(F.coalesce(F.size("points"), F.lit(0)) < 2, "bad-geometry")
        .when(~inside, "outside-bbox")
        .when((F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")), "degenerate-loop")
    )
    return rows.withColumn("reason", reason).withColumn("len_m", geo.polyline_length(F.col("points")))


def skip_counts(rows: DataFrame) -> DataFrame:
    """(reason, n) of the segments left out."""
    return rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def street_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lon, lat) and edges (u, v, len_m) of the largest component; ids by (lon, lat)."""
    kept = stage(rows.filter("reason is null").select("x0", "y0", "x1", "y1", "len_m"))
    corners = kept.select(F.col("x0").alias("lon"), F.col("y0").alias("lat")).union(kept.select("x1", "y1")).distinct()
    corners = stage(corners.withColumn("node", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lon", "lat")).cast("long") - 1))
    for k, name in ((0, "u"), (1, "v")):
        kept = kept.join(corners.select(F.col("lon").alias(f"x{k}"), F.col("lat").alias(f"y{k}"), F.col("node").alias(name)), [f"x{k}", f"y{k}"])
    kept = stage(kept.select("u", "v", "len_m"))
    main = stage(largest_component(kept))
    dense = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")).cast("long") - 1
    ids = stage(main.withColumn("id", dense))
    nodes = corners.join(ids, "node").select(F.col("id").alias("node"), "lon", "lat")
    for name in ("u", "v"):
        kept = kept.join(ids.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id")), name)
    return nodes, kept.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), "len_m")
