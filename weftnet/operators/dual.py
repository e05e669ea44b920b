"""One iteration of the Lagrangian dual as plans over tables.

arcs (arc_id, cost, cap null where uncapacitated), duals (arc_id, lambda),
routes (k, arc_id): the arcs of each commodity's path, commodities (k, demand).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduced_costs(arcs: DataFrame, duals: DataFrame, weight: float = 1.0) -> DataFrame:
    """(arc_id, reduced_cost): cost + weight * lambda; no lambda counts as 0."""
    price = F.coalesce(F.col("lambda"), F.lit(0.0)) * weight
    return arcs.join(duals, "arc_id", "left").select("arc_id", (F.col("cost") + price).alias("reduced_cost"))


def arc_loads(routes: DataFrame, commodities: DataFrame) -> DataFrame:
    """(arc_id, load)."""
    return routes.join(commodities, "k").groupBy("arc_id").agg(F.sum("demand").alias("load"))


def dual_bound(distances: DataFrame, commodities: DataFrame, arcs: DataFrame, duals: DataFrame) -> DataFrame:
    """One row lb: demands times reduced distances (k, dist), less lambda times capacity."""
    gain = distances.join(commodities, "k").agg(F.coalesce(F.sum(F.col("demand") * F.col("dist")), F.lit(0.0)).alias("gain"))
    held = arcs.filter("cap is not null").join(duals, "arc_id").agg(F.coalesce(F.sum(F.col("lambda") * F.col("cap")), F.lit(0.0)).alias("held"))
    return gain.crossJoin(held).select((F.col("gain") - F.col("held")).cast("double").alias("lb"))  # one row each


def gradient(arcs: DataFrame, loads: DataFrame, duals: DataFrame) -> DataFrame:
    """(arc_id, lambda, grad) of capacitated arcs: load - cap, and 0 where that would take lambda below 0."""
    rows = arcs.filter("cap is not null").join(loads, "arc_id", "left").join(duals, "arc_id", "left")
    price, slope = F.coalesce(F.col("lambda"), F.lit(0.0)), F.coalesce(F.col("load"), F.lit(0)) - F.col("cap")
    return rows.select("arc_id", price.alias("lambda"), F.when((price <= 0) & (slope < 0), 0.0).otherwise(slope).cast("double").alias("grad"))


def polyak_step(slopes: DataFrame, lower: float, target: float, alpha: float = 1.5) -> DataFrame:
    """(arc_id, lambda): max(0, lambda + alpha * (target - lower) / |grad|^2 * grad)."""
    norm = slopes.agg(F.sum(F.col("grad") * F.col("grad")).alias("norm"))
    step = F.lit(alpha * max(target - lower, 1e-9)) / F.col("norm")
    moved = slopes.crossJoin(F.broadcast(norm))  # one row
    return moved.select("arc_id", F.when(F.col("norm") > 0, F.greatest(F.lit(0.0), F.col("lambda") + step * F.col("grad"))).otherwise(F.col("lambda")).alias("lambda"))


def worst_overload(arcs: DataFrame, loads: DataFrame) -> DataFrame:
    """One row overload: the largest load / cap."""
    return arcs.filter("cap > 0").join(loads, "arc_id", "left").agg(F.max(F.coalesce(F.col("load"), F.lit(0)) / F.col("cap")).cast("double").alias("overload"))
