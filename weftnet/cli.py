"""Thin command line: ``python -m weftnet.cli gen|solve|design|model ...``; see --help of each."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftnet.functions import geo
from weftnet.operators import design, expand, graph, mcf
from weftnet.plans import model
from weftnet.plans.staging import stage
from weftnet.sources import text


def gen(spark: SparkSession, a: argparse.Namespace) -> int:
    """A time-expanded instance of a grid, or of a street graph, with sampled demand."""
    if a.graph:
        nodes, arcs = text.read_street_graph(spark, a.graph)
        nodes, arcs = nodes.select("node"), arcs.select("src_node", "dst_node", "cost")
    else:
        nodes, arcs = spark.range(a.width * a.height).withColumnRenamed("id", "node"), expand.grid_arcs(spark, a.width, a.height, a.seed)
    n = nodes.count()
    back = arcs.select(F.col("dst_node").alias("src_node"), F.col("src_node").alias("dst_node"))
    near = stage(graph.reachable_sources(graph.hops(back, nodes, a.steps - 1), a.steps))
    coms = expand.sampled_commodities(near, a.commodities, a.hubs, seed=a.seed)
    coms = coms.select("k", "src", (F.col("dst") + (a.steps - 1) * n).alias("dst"), "demand")
    cap = F.lit(float(a.cap) if a.cap >= 0 else None).cast("double")
    te = expand.time_expanded(arcs.withColumn("cap", cap), nodes, a.steps, a.wait)
    rows = te.select("t", expand.fused_node(F.col("t"), F.col("src_node"), n).alias("src_node"), expand.fused_node(F.col("t") + 1, F.col("dst_node"), n).alias("dst_node"), "cost", "cap")
    numbered = model.dense(rows, [F.col("src_node"), F.col("dst_node"), F.col("cost")]).withColumnRenamed("node", "arc_id")
    text.write_instance(n * a.steps, numbered, coms, a.out)
    return 0


def solve(spark: SparkSession, a: argparse.Namespace) -> int:
    n, arcs, coms = text.read_instance(spark, a.instance)
    got = mcf.solve(mcf.Instance.of(arcs, coms, n), mcf.Options(iterations=a.iterations, tolerance=a.tolerance, backend=a.backend, engine=a.engine, primal=not a.bound_only), spark)
    values = {"lb": got.lower, "ub": got.upper, "gap": got.gap, "iters": got.iterations, "status": got.status}
    print(json.dumps(values))
    if a.result:
        text.write_keys(spark, values, a.result)
    if a.flow and got.flow is not None:
        text.write_flow(mcf.flow_table(spark, got), a.flow)
    return 0 if got.upper < float("inf") else 1


def access(spark: SparkSession, a: argparse.Namespace) -> int:
    nodes, arcs = text.read_street_graph(spark, a.graph)
    at = text.read_points(spark, a.points).orderBy("poi").toPandas()
    x, y = geo.project(F.col("lon"), F.col("lat"))
    places = nodes.select("node", x.alias("x"), y.alias("y"), "midblock").toPandas()
    edges = graph.undirected(arcs).orderBy("u", "v").toPandas()
    prices = design.Prices(a.hub_cost, a.cable_cost, a.cap, a.hub_cap, a.splice_cost, a.splice_mid, a.transit, a.max_k, a.seed)
    problem = design.Problem(design.build_net(places, edges, at["node"].to_numpy(), a.transit), at["node"], at["demand"], prices)
    got = design.search(problem, spark if a.engine == "grouped" else None)
    values = design.summary(problem, got) | {"hub_nodes": got.hubs}
    print(json.dumps(values))
    if a.result:
        text.write_keys(spark, values, a.result)
    if a.solution and got.feasible:
        text.write_design(design.tables(spark, problem, got), a.solution)
    return 0 if got.feasible else 1


def compiled(spark: SparkSession, a: argparse.Namespace) -> int:
    with open(a.model) as f:
        c = model.compile_model(spark, f.read(), a.base)
    report = dict(c.report)
    if c.tiers:
        got = model.solve_chain(c, a.rounds)
        keep = ("tier", "hubs", "new_m", "reused_m", "cost", "cable_lb", "splices", "hub_cap_violations")
        report |= {"total_cost": got["total_cost"], "tiers": [{k: t[k] for k in keep} for t in got["tiers"]], "rounds": got["rounds"]}
    else:
        n, arcs, coms = model.flow_tables(c)
        r = mcf.solve(mcf.Instance.of(arcs, coms, n), mcf.Options(tolerance=0.01), spark)
        report |= {"nodes": n, "arcs": arcs.count(), "lb": r.lower, "ub": r.upper, "gap": r.gap}
    print(json.dumps(report))
    return 0


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="weftnet")
    sub = top.add_subparsers(required=True)
    g = sub.add_parser("gen", help=gen.__doc__)
    g.add_argument("out")
    g.add_argument("--graph")
    for name, value in (("width", 10), ("height", 10), ("steps", 8), ("commodities", 10), ("cap", 3), ("seed", 1), ("hubs", 0)):
        g.add_argument(f"--{name}", type=int, default=value)
    g.add_argument("--wait", type=float, default=0.01)
    g.set_defaults(run=gen)
    s = sub.add_parser("solve")
    s.add_argument("instance")
    s.add_argument("--iterations", type=int, default=400)
    s.add_argument("--tolerance", type=float, default=0.005)
    s.add_argument("--backend", choices=("auto", "sweep", "heap"), default="auto")
    s.add_argument("--engine", choices=("auto", "driver", "grouped"), default="auto")
    s.add_argument("--bound-only", action="store_true")
    s.add_argument("--result")
    s.add_argument("--flow")
    s.set_defaults(run=solve)
    d = sub.add_parser("design")
    d.add_argument("--graph", required=True)
    d.add_argument("--points", required=True)
    for name, value in (("hub-cost", 20000.0), ("cable-cost", 10.0), ("cap", 0.0), ("hub-cap", 0.0), ("splice-cost", 0.0), ("splice-mid", 0.0)):
        d.add_argument(f"--{name}", type=float, default=value)
    d.add_argument("--max-k", type=int, default=0)
    d.add_argument("--seed", type=int, default=1)
    d.add_argument("--transit", action="store_true")
    d.add_argument("--engine", choices=("driver", "grouped"), default="grouped")
    d.add_argument("--result")
    d.add_argument("--solution")
    d.set_defaults(run=access)
    m = sub.add_parser("model")
    m.add_argument("model")
    m.add_argument("--base", default=".")
    m.add_argument("--rounds", type=int, default=1)
    m.set_defaults(run=compiled)
    a = top.parse_args(args)
    return a.run(SparkSession.builder.appName("weftnet").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
