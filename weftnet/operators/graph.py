"""Relational graph operators: deduplication, degrees, reachability, shortest layers, forests, components.

Node columns: src_node, dst_node for directed arcs; u, v for undirected edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftnet.plans.staging import stage


def undirected(arcs: DataFrame, length: str = "cost") -> DataFrame:
    """(u, v, len_m) with u < v: of parallel arcs the first by arc_id gives the length; loops go."""
    ends = arcs.filter("src_node <> dst_node").select(
        F.least("src_node", "dst_node").alias("u"), F.greatest("src_node", "dst_node").alias("v"), "arc_id", F.col(length).alias("len_m")
    )
    return ends.groupBy("u", "v").agg(F.min_by("len_m", "arc_id").alias("len_m"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src_node, dst_node) of each undirected edge in both directions, other columns kept."""
    others = [c for c in edges.columns if c not in ("u", "v")]
    ways = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
    return edges.select(*others, ways.alias("w")).select(F.col("w.a").alias("src_node"), F.col("w.b").alias("dst_node"), *others)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return both_ways(edges.select("u", "v")).groupBy(F.col("src_node").alias("node")).agg(F.count("*").alias("degree"))


def splices(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(node, degree, branches): a node of degree d >= 3 that is no hub pays for d - 2 branches."""
    return degrees(edges).filter("degree >= 3").join(hubs.select("node"), "node", "left_anti").withColumn("branches", F.col("degree") - 2)


def splice_cost(edges: DataFrame, hubs: DataFrame, midblock: DataFrame, cost: float, surcharge: float) -> DataFrame:
    """One row: branches, mid_branches, cost; branches at mid-block nodes cost the surcharge on top."""
    at = splices(edges, hubs).join(midblock.select("node", F.lit(1).alias("mid")), "node", "left")
    out = at.agg(
        F.coalesce(F.sum("branches"), F.lit(0)).alias("branches"),
        F.coalesce(F.sum(F.col("branches") * F.coalesce("mid", F.lit(0))), F.lit(0)).alias("mid_branches"),
    )
    return out.withColumn("cost", F.col("branches") * float(cost) + F.col("mid_branches") * float(surcharge))


def with_waiting(arcs: DataFrame, nodes: DataFrame, cost: float = 0) -> DataFrame:
    """(arc_id, src_node, dst_node, cost): arcs and, after them, an arc from each node to itself.

    Waiting as arcs keeps a level sweep linear: each level reads the one before once.
    """
    kind = dict(arcs.dtypes)["cost"]
    waits = nodes.select((-1 - F.col("node")).cast("long").alias("arc_id"), F.col("node").alias("src_node"), F.col("node").alias("dst_node"), F.lit(cost).cast(kind).alias("cost"))
    return arcs.select("arc_id", "src_node", "dst_node", "cost").unionByName(waits)


def layered_distances(arcs: DataFrame, sources: DataFrame, steps: int) -> DataFrame:
    """(source, node, dist, arc_id): least cost over paths of exactly ``steps`` arcs, and the last arc of it.

    Ties go to the smallest arc id. One join and one pre-aggregated shuffle a level.
    """
    level = sources.select(F.col("node").alias("source"), "node", F.lit(0).cast(dict(arcs.dtypes)["cost"]).alias("dist"), F.lit(None).cast("long").alias("arc_id"))
    for _ in range(steps):
        nxt = level.select("source", F.col("node").alias("src_node"), "dist").join(arcs, "src_node")
        best = F.min(F.struct((F.col("dist") + F.col("cost")).alias("dist"), "arc_id"))
        level = nxt.groupBy("source", F.col("dst_node").alias("node")).agg(best.alias("b")).select("source", "node", "b.dist", "b.arc_id")
    return level


def hops(arcs: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, node, hops): least number of arcs, up to ``most``."""
    seen = stage(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")))
    front = seen
    steps = arcs.select("src_node", "dst_node").distinct()
    for k in range(1, most + 1):
        nxt = front.join(steps, front["node"] == steps["src_node"]).select("source", F.col("dst_node").alias("node")).distinct()
        front = stage(nxt.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reachable_sources(hop_table: DataFrame, steps: int) -> DataFrame:
    """(dst, src): nodes that can reach ``dst`` in 1 to steps - 1 arcs; ``hop_table`` is of reversed arcs."""
    return hop_table.filter((F.col("hops") >= 1) & (F.col("hops") <= steps - 1)).select(F.col("source").alias("dst"), F.col("node").alias("src"))


def connected(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node of each node's component.

    Labels spread to neighbours, then jump to their label's label, so a chain of n
    nodes takes about log n rounds; each round is staged.
    """
    ways = stage(both_ways(edges.select("u", "v")))
    labels = stage(ways.groupBy(F.col("src_node").alias("node")).agg(F.least(F.min("dst_node"), F.min("src_node")).alias("component")))
    for _ in range(most_rounds):
        near = ways.join(labels, ways["dst_node"] == labels["node"]).groupBy("src_node").agg(F.min("component").alias("seen"))
        moved = labels.join(near, labels["node"] == near["src_node"]).select("node", F.least("component", "seen").alias("to"), F.col("component").alias("was"))
        jump = moved.select(F.col("node").alias("at"), F.col("to").alias("beyond"))
        out = stage(moved.join(jump, moved["to"] == jump["at"], "left").select("node", F.least("to", F.coalesce("beyond", "to")).alias("component"), "was"))
        labels = out.select("node", "component")
        if out.filter("component <> was").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """(node) of the largest component; ties to the smallest label."""
    labels = stage(connected(edges))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").limit(1)
    return labels.join(top.select("component"), "component", "left_semi").select("node")


def nearest_hub_forest(arcs: DataFrame, hubs: DataFrame, leaves: DataFrame, most_rounds: int) -> DataFrame:
    """(node, dist, hub, parent): nearest hub by length; leaves are reached, not passed.

    Min-plus rounds until nothing changes. Ties: smallest hub, then smallest parent.
    """
    inner = arcs.join(leaves.select(F.col("node").alias("src_node")), "src_node", "left_anti").select("src_node", "dst_node", "cost")
    inner = stage(inner)
    kind = dict(arcs.dtypes)["cost"]
    node = dict(hubs.dtypes)["node"]
    state = stage(hubs.select("node", F.lit(0).cast(kind).alias("dist"), F.col("node").alias("hub"), F.lit(None).cast(node).alias("parent")))
    for _ in range(most_rounds):
        reach = state.join(inner, state["node"] == inner["src_node"]).select(
            F.col("dst_node").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), "hub", F.col("src_node").alias("parent")
        )
        best = state.unionByName(reach).groupBy("node").agg(F.min(F.struct("dist", "hub", "parent")).alias("b"))
        nxt = stage(best.select("node", "b.dist", "b.hub", "b.parent"))
        changed = nxt.join(state.withColumnsRenamed({"dist": "d0", "hub": "h0"}).select("node", "d0", "h0"), "node", "left")
        state = nxt
        if changed.filter("d0 is null or d0 <> dist or h0 <> hub").isEmpty():
            return state
    raise RuntimeError(f"forest did not settle in {most_rounds} rounds")


def subtree_loads(forest: DataFrame, demand: DataFrame, most_depth: int) -> DataFrame:
    """(node, load): demand at and below each node of a forest (node, parent), leaves inward."""
    parents = forest.select("node", "parent")
    carried = demand.groupBy("node").agg(F.sum("demand").alias("load"))
    total, step = carried, carried
    for _ in range(most_depth):
        step = stage(step.join(parents, "node").filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("load").alias("load")))
        if step.isEmpty():
            return total.groupBy("node").agg(F.sum("load").alias("load"))
        total = total.unionByName(step)
    raise RuntimeError(f"forest deeper than {most_depth}")


def served_per_hub(assignment: DataFrame, demand: DataFrame) -> DataFrame:
    """(hub, served): demand of the points assigned to each hub; 1 where a point has none."""
    return assignment.join(demand, "poi", "left").groupBy("hub").agg(F.sum(F.coalesce(F.col("demand"), F.lit(1))).alias("served"))
