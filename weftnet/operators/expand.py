"""Time expansion: arcs between layers, waiting, soft capacity, elastic demand, sampled demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def time_expanded(arcs: DataFrame, nodes: DataFrame, steps: int, wait_cost: float = 0.01) -> DataFrame:
    """(t, src_node, dst_node, cost, cap, kind): every arc and a wait arc of every node from layer t to t + 1.

    Layer and static node stay separate columns; cap is null where there is none.
    """
    waits = nodes.select(
        F.col("node").alias("src_node"), F.col("node").alias("dst_node"), F.lit(wait_cost).cast("double").alias("cost"),
        F.lit(None).cast("double").alias("cap"), F.lit("wait").alias("kind"),
    )
    moves = arcs.select("src_node", "dst_node", F.col("cost").cast("double").alias("cost"), F.col("cap").cast("double").alias("cap"), F.lit("street").alias("kind"))
    layers = arcs.sparkSession.range(max(steps - 1, 0)).select(F.col("id").cast("int").alias("t"))
    # as many rows as layers: small by construction
    return moves.unionByName(waits).crossJoin(F.broadcast(layers)).select("t", "src_node", "dst_node", "cost", "cap", "kind")


def fused_node(t, node, n_static):
    """Node id of a layer, for files that have one id only."""
    return t * n_static + node


def overflow_arcs(expanded: DataFrame, penalty: float, most_factor: float | None = None) -> DataFrame:
    """``expanded`` with, beside each capacitated arc, one of cost + penalty for what exceeds the capacity."""
    over = F.lit(None).cast("double") if most_factor is None else F.col("cap") * (most_factor - 1)
    extra = expanded.filter("cap is not null").withColumns({"cost": F.col("cost") + penalty, "cap": over, "kind": F.lit("overflow")})
    return expanded.unionByName(extra)


def relief_arcs(commodities: DataFrame, steps: int, penalty: float) -> DataFrame:
    """(k, src, dst, t_from, t_to, cost): one uncapacitated arc from source to destination a commodity."""
    return commodities.select("k", "src", "dst", F.lit(0).alias("t_from"), F.lit(steps - 1).alias("t_to"), F.lit(float(penalty)).alias("cost"))


def hashed(seed: int, *columns, most: int):
    """A number in [0, most) that depends on seed and columns alone, not on where rows lie."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(most))


def grid_arcs(spark: SparkSession, width: int, height: int, seed: int = 1) -> DataFrame:
    """(arc_id, src_node, dst_node, cost): four neighbours of a grid's nodes, whole costs of 1 to 10 a direction."""
    cells = spark.range(width * height).select(F.col("id").alias("node"), (F.col("id") % width).alias("x"), F.expr(f"id div {width}").alias("y"))
    moves = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = cells.select("node", "x", "y", F.posexplode(moves).alias("way", "m"))
    near = near.withColumns({"x2": F.col("x") + F.col("m.dx"), "y2": F.col("y") + F.col("m.dy")})
    near = near.filter(f"x2 between 0 and {width - 1} and y2 between 0 and {height - 1}")
    to = (F.col("y2") * width + F.col("x2")).cast("long")
    cost = (hashed(seed, F.col("node"), to, most=10) + 1).cast("double")
    return near.select((F.col("node") * 4 + F.col("way")).alias("arc_id"), F.col("node").alias("src_node"), to.alias("dst_node"), cost.alias("cost"))


def sampled_commodities(reachable: DataFrame, count: int, hubs: int = 0, hub_share: float = 0.6, seed: int = 1, least_sources: int = 2) -> DataFrame:
    """(k, src, dst, demand): ``count`` pairs drawn by hash from ``reachable`` (dst, src), demands 1 to 3.

    Destinations need ``least_sources`` sources; a share of the commodities goes to a
    few hub destinations, those with most sources among hash-ranked candidates.
    """
    able = reachable.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= least_sources)
    named = [r["dst"] for r in able.orderBy(F.xxhash64(F.lit(seed), "dst")).limit(max(count, hubs)).collect()]  # at most ``count`` ids
    if not named:
        raise ValueError("no destination can be reached; take more time steps")
    spark = reachable.sparkSession
    hub_ids = named[:hubs]
    want = spark.range(count).select(F.col("id").alias("k"))
    lucky = hashed(seed + 1, F.col("k"), most=1000) < int(1000 * hub_share)
    pick = F.array(*[F.lit(x) for x in named])
    at_hub = F.get(F.array(*[F.lit(x) for x in hub_ids]), (F.col("k") % max(len(hub_ids), 1)).cast("int")) if hub_ids else F.lit(None)
    anywhere = F.get(pick, hashed(seed + 2, F.col("k"), most=len(named)).cast("int"))
    want = want.withColumn("dst", F.coalesce(F.when(lucky, at_hub), anywhere))
    cands = want.join(reachable, "dst")
    best = cands.groupBy("k", "dst").agg(F.min(F.struct(F.xxhash64(F.lit(seed + 3), "k", "src"), "src")).alias("b"))
    return best.select("k", F.col("b.src").alias("src"), "dst", (hashed(seed + 4, F.col("k"), most=3) + 1).cast("double").alias("demand"))
