"""Registered queries of the network operators; each takes (spark, sf_dir) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftnet.functions import geo
from weftnet.operators import coupling, design, dual, expand, graph, mcf, rules
from weftnet.plans import derive, model
from weftnet.plans.staging import stage

STEPS = 6


def _trade(spark, sf_dir):
    return derive.trade_arcs(spark, sf_dir), derive.trade_nodes(spark, sf_dir)


def _duals(arcs: DataFrame) -> DataFrame:
    """Prices to test a dual iteration with: 0 to 6 by arc."""
    return arcs.select("arc_id", (F.col("arc_id") % 7).cast("double").alias("lambda"))


def _routes(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each commodity takes its own arc and the first arc out of where that leads."""
    coms = derive.trade_commodities(arcs)
    direct = coms.join(arcs, (F.col("src") == F.col("src_node")) & (F.col("dst") == F.col("dst_node"))).select("k", "arc_id", "dst")
    first = arcs.groupBy(F.col("src_node").alias("dst")).agg(F.min("arc_id").alias("next"))
    onward = direct.join(first, "dst").select("k", F.col("next").alias("arc_id"))
    return coms, direct.select("k", "arc_id").unionByName(onward)


def arc_table(spark, sf_dir):
    return derive.trade_arcs(spark, sf_dir)


def undirected_dedup(spark, sf_dir):
    return graph.undirected(derive.trade_arcs(spark, sf_dir))


def supply_graph(spark, sf_dir):
    edges = derive.supply_edges(spark, sf_dir)
    return graph.degrees(edges).groupBy("degree").agg(F.count("*").alias("nodes"))


def degree_splice(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    hubs = nodes.groupBy("region").agg(F.min("node").alias("node")).select("node")
    return graph.splices(graph.undirected(arcs).filter("len_m % 3 = 0"), hubs)


def splice_charge(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    hubs = nodes.groupBy("region").agg(F.min("node").alias("node")).select("node")
    return graph.splice_cost(graph.undirected(arcs).filter("len_m % 3 = 0"), hubs, nodes.filter("node % 2 = 1"), 500, 100)


def time_expand_counts(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    return expand.time_expanded(arcs, nodes, STEPS).groupBy("t", "kind").agg(F.count("*").alias("arcs"), F.sum("cost").alias("cost"))


def soft_overflow_arcs(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    return expand.overflow_arcs(expand.time_expanded(arcs, nodes, STEPS), 200.0, 3.0)


def relief_arcs(spark, sf_dir):
    return expand.relief_arcs(derive.trade_commodities(derive.trade_arcs(spark, sf_dir)), STEPS, 1000.0)


def te_shortest_path(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    every = stage(graph.with_waiting(arcs, nodes))
    return graph.layered_distances(every, nodes, STEPS - 1).select("source", "node", "dist")


def te_shortest_path_parent(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    every = stage(graph.with_waiting(arcs, nodes))
    return graph.layered_distances(every, nodes, STEPS - 1).select("source", "node", "arc_id")


def _sparse(arcs: DataFrame) -> DataFrame:
    return arcs.filter("cost % 5 = 0")


def bfs_hops(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    return graph.hops(_sparse(arcs), nodes.select("node"), STEPS)


def reachable_sources(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    back = _sparse(arcs).select(F.col("dst_node").alias("src_node"), F.col("src_node").alias("dst_node"))
    return graph.reachable_sources(graph.hops(back, nodes.select("node"), STEPS), 3)


def components_largest(spark, sf_dir):
    edges = derive.supply_edges(spark, sf_dir).filter("(u + v) % 37 = 0")
    return graph.largest_component(edges)


def component_sizes(spark, sf_dir):
    edges = derive.supply_edges(spark, sf_dir).filter("(u + v) % 37 = 0")
    return graph.connected(edges).groupBy("component").agg(F.count("*").alias("nodes"))


def reduced_cost(spark, sf_dir):
    arcs = derive.trade_arcs(spark, sf_dir)
    return dual.reduced_costs(arcs, _duals(arcs), 3.0)


def arc_load(spark, sf_dir):
    coms, routes = _routes(derive.trade_arcs(spark, sf_dir))
    return dual.arc_loads(routes, coms)


def dual_bound(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    duals, coms = _duals(arcs), derive.trade_commodities(arcs)
    priced = arcs.join(dual.reduced_costs(arcs, duals), "arc_id").select("arc_id", "src_node", "dst_node", F.col("reduced_cost").alias("cost"))
    table = graph.layered_distances(stage(graph.with_waiting(priced, nodes, 0.0)), nodes, STEPS - 1)
    dist = coms.join(table, (F.col("src") == F.col("source")) & (F.col("dst") == F.col("node"))).select("k", "dist")
    return dual.dual_bound(dist, coms, arcs, duals)


def _slopes(arcs: DataFrame) -> DataFrame:
    coms, routes = _routes(arcs)
    # capacities of a twentieth, so that some arcs are overloaded
    return dual.gradient(arcs.withColumn("cap", F.expr("cap div 20")), dual.arc_loads(routes, coms), _duals(arcs))


def dual_gradient(spark, sf_dir):
    return _slopes(derive.trade_arcs(spark, sf_dir))


def polyak_step(spark, sf_dir):
    return dual.polyak_step(_slopes(derive.trade_arcs(spark, sf_dir)), 1000.0, 5000.0)


def max_overload(spark, sf_dir):
    arcs = derive.trade_arcs(spark, sf_dir)
    coms, routes = _routes(arcs)
    return dual.worst_overload(arcs, dual.arc_loads(routes, coms))


CAPACITY_RULES = [
    {"where": {"edges": {"layer": "*"}}, "capacity": {"hard": 100}},
    {"where": {"edges": {"layer": "even"}}, "capacity": {"soft": 20, "penalty_per_unit": 200, "max": 60}},
    {"where": "arterials", "capacity": {"hard": 1}},
    {"where": {"edges": {"layer": "odd"}}, "capacity": {"hard": 7}},
]


def capacity_resolution(spark, sf_dir):
    arcs = derive.trade_arcs(spark, sf_dir)
    layer = F.when(F.col("src_node") % 3 == 0, "other").when(F.col("arc_id") % 2 == 0, "even").otherwise("odd")
    edges = arcs.select(F.col("arc_id").alias("edge_id"), layer.alias("layer"))
    return rules.resolved_capacity(edges, rules.rule_table(spark, CAPACITY_RULES))


def _forest(spark, sf_dir):
    arcs, nodes = _trade(spark, sf_dir)
    hubs = nodes.filter("node % 11 = 0").select("node")
    leaves = nodes.filter("node % 4 = 3 and node % 11 <> 0").select("node")
    return arcs, nodes, graph.nearest_hub_forest(arcs, hubs, leaves, 30)


def nearest_hub_forest(spark, sf_dir):
    return _forest(spark, sf_dir)[2]


def subtree_load(spark, sf_dir):
    arcs, nodes, forest = _forest(spark, sf_dir)
    demand = nodes.select("node", (F.col("node") % 5 + 1).cast("long").alias("demand"))
    return graph.subtree_loads(forest, demand, 30)


def served_per_hub(spark, sf_dir):
    _, nodes, forest = _forest(spark, sf_dir)
    demand = nodes.filter("node % 2 = 0").select(F.col("node").alias("poi"), (F.col("node") % 5 + 1).cast("long").alias("demand"))
    return graph.served_per_hub(forest.select(F.col("node").alias("poi"), "hub"), demand)


def _coupled(spark, sf_dir):
    points = derive.planar_points(spark, sf_dir)
    streets = stage(derive.planar_streets(points))
    return streets, coupling.nearest_edge(derive.planar_demand(points), streets)


def nearest_edge(spark, sf_dir):
    _, near = _coupled(spark, sf_dir)
    return near.select("poi", "edge_id", F.round("t", 6).alias("t"), F.round("dist", 6).alias("dist"))


def side_of_street(spark, sf_dir):
    return _coupled(spark, sf_dir)[1].select("poi", "side")


def drop_quantiles(spark, sf_dir):
    _, near = _coupled(spark, sf_dir)
    q = [F.round(F.percentile("dist", p), 6).alias(n) for n, p in (("median", 0.5), ("p95", 0.95))]
    return near.agg(*q, F.round(F.avg("dist"), 6).alias("mean"), F.round(F.max("dist"), 6).alias("longest"))


def drop_limit(spark, sf_dir):
    _, near = _coupled(spark, sf_dir)
    return near.agg(F.count_if(F.col("dist") <= 20).alias("kept"), F.count_if(F.col("dist") > 20).alias("skipped"))


def edge_split_lengths(spark, sf_dir):
    """Meters of each street after the cut; they add up to what it had."""
    streets, near = _coupled(spark, sf_dir)
    pieces = coupling.split_streets(near, streets).filter("kind = 'street'")
    return pieces.groupBy("edge_id").agg(F.round(F.sum("len_m"), 6).alias("len_m"))


def sided_split(spark, sf_dir):
    streets, near = _coupled(spark, sf_dir)
    pieces = coupling.split_sides(near, streets, cross=15.0)
    return pieces.groupBy("kind").agg(F.count("*").alias("pieces"), F.round(F.sum("len_m"), 3).alias("len_m"))


def project_xy(spark, sf_dir):
    p = derive.planar_points(spark, sf_dir)
    x, y = geo.project(F.lit(-122.4) + F.col("x") / 1e5, F.lit(37.77) + F.col("y") / 1e5)
    return p.select("id", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


def haversine_length(spark, sf_dir):
    s = derive.planar_streets(derive.planar_points(spark, sf_dir))
    at = lambda c, base: F.lit(base) + F.col(c) / 1e5
    meters = geo.haversine(at("ux", -122.4), at("uy", 37.77), at("vx", -122.4), at("vy", 37.77))
    return s.select("edge_id", F.round(meters, 5).alias("meters"))


def kmeans_round(spark, sf_dir):
    """One round: centres are the points whose id fifty divides."""
    d = derive.planar_demand(derive.planar_points(spark, sf_dir))
    centres = d.orderBy("poi").limit(8).select(F.col("poi").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    far = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    near = d.crossJoin(F.broadcast(centres)).groupBy("poi").agg(F.min(F.struct(far.alias("d"), "c", "x", "y")).alias("b"))  # eight centres
    return near.groupBy(F.col("b.c").alias("centre")).agg(F.round(F.avg("b.x"), 6).alias("x"), F.round(F.avg("b.y"), 6).alias("y"), F.count("*").alias("points"))


def recenter(spark, sf_dir):
    """The street node nearest to the mean of each label's points."""
    p = derive.planar_points(spark, sf_dir)
    means = p.filter("label <= 4").groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    sites = p.filter("label >= 5").select("id", "x", "y")
    far = F.round((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2, 6)
    best = sites.crossJoin(F.broadcast(means)).groupBy(F.col("label").alias("hub")).agg(F.min(F.struct(far.alias("d"), "id")).alias("b"))  # five means
    return best.select("hub", F.col("b.id").alias("site"))


def commodity_order(spark, sf_dir):
    return rules.commodity_order(derive.trade_commodities(derive.trade_arcs(spark, sf_dir)).select("k", "demand"))


def relief_topk(spark, sf_dir):
    _, nodes, forest = _forest(spark, sf_dir)
    forest = stage(forest)
    demand = nodes.select("node", (F.col("node") % 5 + 1).cast("long").alias("demand"))
    loads = graph.subtree_loads(forest, demand, 30).join(forest.filter("parent is not null").select("node"), "node", "left_semi")
    above = forest.filter("parent is not null").select("node", F.col("parent").alias("above"))
    chain, step = above, above
    for _ in range(10):
        step = stage(step.join(above.select(F.col("node").alias("above"), F.col("above").alias("up")), "above").select("node", F.col("up").alias("above")))
        if step.isEmpty():
            break
        chain = chain.unionByName(step)
    return rules.relief_candidates(stage(loads), 3, chain)


def prune_candidates(spark, sf_dir):
    return rules.prune_candidates(served_per_hub(spark, sf_dir), 2)


def _event_arcs(spark, sf_dir):
    """Users' flow by day on the arc from their number modulo 25 to the next."""
    e = derive.event_flow(spark, sf_dir)
    return e.select("t", (F.col("k") % 25).alias("src_node"), ((F.col("k") * 7 + F.col("t")) % 25).alias("dst_node"), F.col("qty").cast("double").alias("flow"))


def flow_rollup(spark, sf_dir):
    return rules.flow_rollup(_event_arcs(spark, sf_dir))


def wait_flow(spark, sf_dir):
    w = _event_arcs(spark, sf_dir).filter("src_node = dst_node and flow > 1e-9")
    return w.groupBy(F.col("src_node").alias("node")).agg(F.sum("flow").alias("flow"))


def flow_cost_check(spark, sf_dir):
    arcs = derive.trade_arcs(spark, sf_dir)
    coms, routes = _routes(arcs)
    return rules.flow_cost(dual.arc_loads(routes, coms).select("arc_id", F.col("load").alias("flow")), arcs)


def duct_reuse(spark, sf_dir):
    lengths = stage(graph.undirected(derive.trade_arcs(spark, sf_dir)))
    return rules.reuse(lengths.filter("len_m % 2 = 0"), lengths.filter("len_m % 3 = 0"), lengths, 0.25)


def systematic_subsample(spark, sf_dir):
    from weftnet.sources.geoparquet import every_kth

    return every_kth(derive.planar_demand(derive.planar_points(spark, sf_dir)).select("poi"), ["poi"], 60)


def grid_generator(spark, sf_dir):
    return expand.grid_arcs(spark, 20, 20, seed=7)


def _instance(spark, sf_dir) -> tuple[DataFrame, mcf.Instance]:
    arcs, nodes = _trade(spark, sf_dir)
    n = nodes.count()
    moves = arcs.select("src_node", "dst_node", F.col("cost").cast("double").alias("cost"), (F.col("cap") / 8).cast("double").alias("cap"))
    te = expand.time_expanded(moves, nodes, 4)
    ids = te.select((F.col("t") * n + F.col("src_node")).alias("src_node"), ((F.col("t") + 1) * n + F.col("dst_node")).alias("dst_node"), "cost", "cap")
    numbered = stage(model.dense(ids, [F.col("src_node"), F.col("dst_node")]).withColumnRenamed("node", "arc_id"))
    coms = derive.trade_commodities(arcs, 1).select("k", "src", (F.col("dst") + 3 * n).alias("dst"), "demand")
    return numbered, mcf.Instance.of(numbered, coms, 4 * n)


def mcf_solve(spark, sf_dir):
    _, inst = _instance(spark, sf_dir)
    return mcf.result_row(spark, mcf.solve(inst, mcf.Options(), spark))


def mcf_flow(spark, sf_dir):
    arcs, inst = _instance(spark, sf_dir)
    got = mcf.solve(inst, mcf.Options(), spark)
    return mcf.flow_table(spark, got).join(arcs, "arc_id")


PLANAR_MODEL = {
    "model_version": 1,
    "layers": {"streets": {}, "addresses": {"role": "terminals"}},
    "couplings": [{"name": "drops", "from": "addresses", "to": "streets", "method": "nearest_edge_split", "snap_m": 0.5}],
    "facilities": {
        "terminal": {"open_cost": 500, "capacity": {"hard": 24}},
        "cabinet": {"open_cost": 20000, "capacity": {"hard": 1024}},
    },
    "cable": {"fixed_cost_per_m": 10, "reuse_factor": 0.25},
}


def _planar(spark, sf_dir, more: dict | None = None) -> model.Compiled:
    """The planar model; a chord joins the streets of the labels, so that all points are connected."""
    p = derive.planar_points(spark, sf_dir)
    streets = derive.planar_streets(p)
    first = p.filter("label >= 5").groupBy("label").agg(F.min("id").alias("id"))
    w = Window.partitionBy(F.lit(0)).orderBy("label")
    links = first.select(F.col("id").alias("src_node"), F.lead("id").over(w).alias("dst_node")).filter("dst_node is not null")
    lonlat = [c.alias(n) for c, n in zip(geo.unproject(F.col("x"), F.col("y")), ("lon", "lat"))]
    used = p.filter("label >= 5")
    ids = stage(model.dense(used.select("id", "x", "y"), [F.col("id")]))
    nodes = ids.select("node", *lonlat)
    near = lambda a, c: ids.select(F.col("id").alias(a), F.col("node").alias(c))
    pairs = streets.select(F.col("u").alias("src_node"), F.col("v").alias("dst_node")).unionByName(links)
    pairs = pairs.join(near("src_node", "a"), "src_node").join(near("dst_node", "b"), "dst_node").select("a", "b")
    spots = ids.select("node", "x", "y")
    for end in ("a", "b"):
        pairs = pairs.join(spots.select(F.col("node").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}")), end)
    length = geo.distance(F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb"))
    numbered = model.dense(pairs.select("a", "b", length.alias("cost")), [F.col("a"), F.col("b")])
    arcs = numbered.select(F.col("node").alias("arc_id"), F.col("a").alias("src_node"), F.col("b").alias("dst_node"), "cost")
    demand = derive.planar_demand(p).select("poi", *lonlat, "demand")
    return model.compile_model(spark, PLANAR_MODEL | (more or {}), layers={"streets": (nodes, arcs), "addresses": demand})


def model_compile(spark, sf_dir):
    c = _planar(spark, sf_dir)
    return c.edges.groupBy("layer", "kind").agg(F.count("*").alias("edges"), F.round(F.sum("len_m"), 3).alias("len_m"))


def _first_tier(spark, sf_dir):
    c = _planar(spark, sf_dir)
    nodes = c.nodes.select("node", "x", "y", "midblock").toPandas()
    edges = c.edges.select("u", "v", "len_m").toPandas()
    at = c.points.orderBy("poi").toPandas()
    net = design.build_net(nodes, edges, at["node"].to_numpy())
    return c, design.Problem(net, at["node"].tolist(), at["demand"].tolist(), design.Prices(hub_cost=3000.0, hub_cap=64.0, max_k=32))


def design_solve(spark, sf_dir):
    _, problem = _first_tier(spark, sf_dir)
    got = design.summary(problem, design.search(problem, spark))
    names = ("feasible", "hubs", "cable_m", "cable_lb", "total_cost", "hub_cap_violations")
    return spark.createDataFrame([tuple(got[n] for n in names)], "feasible boolean, hubs int, cable_m double, cable_lb double, total_cost double, hub_cap_violations int")


def sph_cluster(spark, sf_dir):
    _, problem = _first_tier(spark, sf_dir)
    forest, hubs, _ = problem.routed(problem.seeds(12))
    return design.consolidated_clusters(problem, forest, spark)


def dual_ascent(spark, sf_dir):
    return sph_cluster(spark, sf_dir).agg(F.sum("bound").alias("bound"), F.sum("meters").alias("meters"), F.count("*").alias("clusters"))


def design_features(spark, sf_dir):
    from weftnet.operators import export

    c, problem = _first_tier(spark, sf_dir)
    forest, hubs, load = problem.routed(problem.seeds(12))
    at = {int(e): float(load[e]) for e in range(len(load)) if load[e] > 0}
    got = problem.priced(hubs, at, [forest.hub[b] for b in problem.points.tolist()], 0.0)
    return export.design_features(design.tables(spark, problem, got), c.nodes)


def tier_chain(spark, sf_dir):
    got = model.solve_chain(_planar(spark, sf_dir), rounds=2, spark=spark)
    rows = [(t["tier"], t["hubs"], float(t["new_m"]), float(t["reused_m"]), float(t["cost"])) for t in got["tiers"]]
    return spark.createDataFrame(rows, "tier string, hubs int, new_m double, reused_m double, cost double")


def te_model(spark, sf_dir):
    flow = {"facilities": None, "time_expansion": {"steps": 4}, "commodities": [{"pairs": [{"src": 0, "dst": 5, "demand": 2}]}], "objective": {"unserved_penalty": {"per_unit": 1e5}}}
    rule = [{"where": {"edges": {"layer": "streets"}}, "capacity": {"soft": 4, "penalty_per_unit": 50}}]
    c = _planar(spark, sf_dir, flow | {"edge_capacities": rule})
    _, arcs, _ = model.flow_tables(c)
    return arcs.groupBy("origin").agg(F.count("*").alias("arcs"), F.round(F.sum("cost"), 2).alias("cost"))


NAMES = """arc_table undirected_dedup supply_graph degree_splice splice_charge time_expand_counts soft_overflow_arcs relief_arcs te_shortest_path
te_shortest_path_parent bfs_hops reachable_sources components_largest component_sizes reduced_cost arc_load dual_bound dual_gradient
polyak_step max_overload capacity_resolution nearest_hub_forest subtree_load served_per_hub nearest_edge side_of_street drop_quantiles
drop_limit edge_split_lengths sided_split project_xy haversine_length kmeans_round recenter commodity_order relief_topk prune_candidates
flow_rollup wait_flow flow_cost_check duct_reuse systematic_subsample grid_generator mcf_solve mcf_flow model_compile design_solve
sph_cluster dual_ascent design_features tier_chain te_model""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}
