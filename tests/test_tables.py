"""Relational operators on small tables, text formats, coupling, models."""

import math

import pytest
from pyspark.sql import functions as F

from weftnet.functions import geo, wkb
from weftnet.operators import coupling, dual, expand, graph, rules
from weftnet.plans import model
from weftnet.sources import geoparquet, streets, text

STREET4 = [(0, 1, 100.0), (1, 2, 50.0), (2, 3, 200.0)]


def arcs_of(spark, edges):
    ways = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    return spark.createDataFrame([(i, *x, None) for i, x in enumerate(ways)], "arc_id long, src_node long, dst_node long, cost double, cap double")


def test_first_of_parallel_arcs_gives_the_length(spark):
    arcs = spark.createDataFrame([(0, 1, 2, 9.0), (1, 2, 1, 5.0), (2, 3, 3, 1.0)], "arc_id long, src_node int, dst_node int, cost double")
    assert [tuple(r) for r in graph.undirected(arcs).collect()] == [(1, 2, 9.0)]


def test_time_expansion_of_a_street(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    te = expand.time_expanded(arcs_of(spark, STREET4), nodes, 5)
    assert te.count() == 40 and te.filter("kind = 'wait'").count() == 16


def test_grid_expansion_shape(spark):
    arcs = expand.grid_arcs(spark, 5, 4)
    assert arcs.count() == 62 and arcs.select("arc_id").distinct().count() == 62
    nodes = spark.range(20).withColumnRenamed("id", "node")
    assert expand.time_expanded(arcs.withColumn("cap", F.lit(None).cast("double")), nodes, 7).count() == (62 + 20) * 6


def test_overflow_and_relief(spark):
    te = spark.createDataFrame([(0, 0, 1, 2.0, 5.0, "street"), (0, 0, 0, 0.0, None, "wait")], "t int, src_node int, dst_node int, cost double, cap double, kind string")
    extra = expand.overflow_arcs(te, 10.0, 3.0).filter("kind = 'overflow'").collect()
    assert [(r.cost, r.cap) for r in extra] == [(12.0, 10.0)]


def test_sampled_commodities_are_reachable_and_repeatable(spark):
    near = spark.createDataFrame([(d, s) for d in range(5) for s in range(5) if s != d], "dst long, src long")
    a, b = ([tuple(r) for r in expand.sampled_commodities(near, 20, hubs=2, seed=3).orderBy("k").collect()] for _ in range(2))
    assert a == b and len(a) == 20 and all(s != d and 1 <= q <= 3 for _, s, d, q in a)


def test_layered_distances_tie_to_the_smallest_arc(spark):
    arcs = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 2, 1), (2, 1, 3, 1), (3, 2, 3, 1)], "arc_id long, src_node int, dst_node int, cost int")
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node int")
    every = graph.with_waiting(arcs, nodes)
    got = {(r.source, r.node): (r.dist, r.arc_id) for r in graph.layered_distances(every, nodes, 2).collect()}
    assert got[0, 3] == (2, 2) and (3, 0) not in got


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "u long, v long")
    got = dict(tuple(r) for r in graph.connected(edges).collect())
    assert all(got[i] == 0 for i in range(21)) and got[51] == 50 and got[60] == 60
    assert graph.largest_component(edges).count() == 21


def test_forest_stops_at_leaves(spark):
    arcs = arcs_of(spark, [(0, 1, 1.0), (1, 2, 1.0)]).select("src_node", "dst_node", "cost")
    one = lambda k: spark.createDataFrame([(k,)], "node long")
    assert {r.node for r in graph.nearest_hub_forest(arcs, one(0), one(1), 10).collect()} == {0, 1}


def test_rules_last_match_wins_and_named_selectors_match_nothing(spark):
    table = rules.rule_table(spark, [{"where": {"edges": {}}, "capacity": {"hard": 5}}, {"where": "x", "capacity": {"hard": 1}}, {True: {"edges": {"layer": "a"}}, "capacity": {"soft": 2, "penalty_per_unit": 3}}])
    edges = spark.createDataFrame([(0, "a"), (1, "b")], "edge_id int, layer string")
    got = {r.edge_id: (r.kind, r.cap, r.max_cap) for r in rules.resolved_capacity(edges, table).collect()}
    assert got == {0: ("soft", 2.0, None), 1: ("hard", 5.0, None)}
    with pytest.raises(ValueError):
        rules.rule_table(spark, [{"where": {"edges": {}}, "capacity": {}}])


def test_gradient_projects_at_zero(spark):
    arcs = spark.createDataFrame([(0, 1.0, 5.0), (1, 1.0, 1.0), (2, 1.0, None)], "arc_id long, cost double, cap double")
    loads = spark.createDataFrame([(0, 2.0), (1, 4.0)], "arc_id long, load double")
    none = spark.createDataFrame([], "arc_id long, lambda double")
    assert {r.arc_id: r.grad for r in dual.gradient(arcs, loads, none).collect()} == {0: 0.0, 1: 3.0}
    assert {r.arc_id: r["lambda"] for r in dual.polyak_step(dual.gradient(arcs, loads, none), 0, 9, 1.0).collect()} == {0: 0.0, 1: 3.0}


def brute_nearest(points, edges):
    out = {}
    for p, x, y in points:
        best = None
        for e, ux, uy, vx, vy in edges:
            dx, dy = vx - ux, vy - uy
            t = min(max(((x - ux) * dx + (y - uy) * dy) / (dx * dx + dy * dy or 1), 0), 1)
            d = math.dist((x, y), (ux + t * dx, uy + t * dy))
            best = min(best, (d, e)) if best else (d, e)
        out[p] = best
    return out


def test_nearest_edge_looks_as_far_as_needed(spark):
    import random

    r = random.Random(4)
    edges = [(i, *(r.uniform(0, 100) for _ in range(2)), *(r.uniform(0, 100) for _ in range(2))) for i in range(30)]
    points = [(i, r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(40)]
    got = coupling.nearest_edge(spark.createDataFrame(points, "poi long, x double, y double"), spark.createDataFrame(edges, "edge_id long, ux double, uy double, vx double, vy double"), cell=7.0)
    want = brute_nearest(points, edges)
    rows = got.collect()
    assert len(rows) == 40 and all(abs(x.dist - want[x.poi][0]) < 1e-9 and x.edge_id == want[x.poi][1] for x in rows)


def test_nearest_edge_of_clusters_copies_and_flat_edges(spark):
    import random

    r = random.Random(7)
    edges = [(i, *(r.gauss(0, 90) for _ in range(4))) for i in range(200)]
    edges += [(200 + i, 5.0 * i, -200.0, 5.0 * i + 1e-13 * (i % 2), 200.0) for i in range(20)]  # upright, or nearly
    edges += [(300 + i, float(i), float(i), float(i), float(i)) for i in range(10)] + [(400 + e[0], *e[1:]) for e in edges[:50]]
    points = [(i, r.gauss(0, 1), r.gauss(0, 1)) for i in range(300)] + [(300 + i, r.gauss(300, 100), r.gauss(0, 100)) for i in range(100)]
    points += [(400 + i, *points[i % 3][1:]) for i in range(100)]
    odd = [(900, None, 1.0), (901, float("nan"), 1.0)]
    kinds = "poi long, x double, y double", "edge_id long, ux double, uy double, vx double, vy double"
    lost = [(901, None, 1.0, 2.0, 2.0), (902, float("nan"), 1.0, 2.0, 2.0)]
    got = coupling.nearest_edge(spark.createDataFrame(points + odd, kinds[0]), spark.createDataFrame(edges + lost, kinds[1])).collect()
    want = brute_nearest(points, edges)
    assert sorted(g.poi for g in got) == list(range(500))
    assert all(abs(g.dist - want[g.poi][0]) < 1e-9 and g.edge_id == want[g.poi][1] for g in got)


def test_long_edges_go_only_to_tiles_they_cross(spark):
    edge = spark.createDataFrame([(0, 0.5, 0.5, 99.5, 98.5)], "edge_id long, ux double, uy double, vx double, vy double")
    assert coupling._tiles_of_edges(edge, 1.0, 1e-6).count() < 300  # of 10,000 in its rectangle


@pytest.fixture()
def one_street(spark):
    edges = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 100.0, 0.0, 120.0)], "edge_id long, u long, v long, ux double, uy double, vx double, vy double, len_m double")
    near = spark.createDataFrame([(0, 30.0, 5.0, 0, 0.3, 5.0, 1), (1, 30.2, -4.0, 0, 0.302, 4.0, -1), (2, 0.1, 2.0, 0, 0.001, 2.0, 1), (3, 80.0, 0.0, 0, 0.8, 0.0, 1)], "poi long, x double, y double, edge_id long, t double, dist double, side int")
    return edges, near


def test_split_keeps_the_length_and_snaps(spark, one_street):
    edges, near = one_street
    rows = coupling.split_streets(near, edges).orderBy("seq").collect()
    street = [r for r in rows if r.kind == "street"]
    assert abs(sum(r.len_m for r in street) - 120) < 1e-9 and len(street) == 3
    foot = {r.a: r.b for r in rows if r.kind == "drop"}
    assert foot["p:0"] == foot["p:1"] and foot["p:2"] == "n:0"
    assert min(r.len_m for r in rows if r.kind == "drop") == 0.1


def test_streets_are_cut_many_a_batch(spark, one_street):
    edges, near = one_street
    for pieces in (coupling.split_streets(near, edges), coupling.split_sides(near, edges, cross=15.0)):
        plan = pieces._jdf.queryExecution().toString()
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_sides(spark, one_street):
    edges, near = one_street
    rows = coupling.split_sides(near, edges, cross=15.0).collect()
    for s in "lr":
        chain = [r.len_m for r in rows if r.kind == "street" and (f":{s}" in r.b or f":{s}" in r.a)]
        assert abs(sum(chain) - 120) < 0.1
    foot = {r.a: r.b for r in rows if r.kind == "drop"}
    assert ":l" in foot["p:0"] and ":r" in foot["p:1"]
    assert {r.len_m for r in rows if r.kind == "cross"} == {15.0}
    assert not [r for r in coupling.split_sides(near, edges).collect() if r.kind == "cross"]


def test_geometry(spark):
    row = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), geo.side(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("s")).first()
    assert abs(row.d - 6371000 * math.pi / 180) < 1e-6 and row.s == 1
    assert wkb.parse(wkb.line_bytes([(1, 2), (3, 4)])) == [(1, 2), (3, 4)] and wkb.parse(b"\x01\x09\0\0\0") is None


def test_instance_round_trip(spark, tmp_path):
    arcs = spark.createDataFrame([(0, 0, 1, 1.5, None), (1, 1, 2, 2.0, 3.0)], "arc_id long, src_node long, dst_node long, cost double, cap double")
    coms = spark.createDataFrame([(0, 0, 2, 4.0)], "k long, src long, dst long, demand double")
    text.write_instance(3, arcs, coms, str(tmp_path / "i"))
    n, a, k = text.read_instance(spark, str(tmp_path / "i"))
    assert n == 3 and sorted(map(tuple, a.collect())) == sorted(map(tuple, arcs.collect())) and k.collect() == coms.collect()


def test_bad_instances(spark, tmp_path):
    for i, body in enumerate(["p 2 1 0\n", "p 2 1 0\na 0 5 1 -1\n", "p 2 0 0\nz 1\n", "a 0 1 1 1\n"]):
        (tmp_path / f"b{i}").write_text(body)
        with pytest.raises(text.BadFile):
            text.read_instance(spark, str(tmp_path / f"b{i}"))


def test_graph_points_and_demand_scans(spark, tmp_path):
    (tmp_path / "g").write_text("c a comment\ng 2 1\nv 0 1.0 2.0\nv 1 1.5 2.0 m\ne 0 1 7.25\n")
    nodes, arcs = text.read_street_graph(spark, str(tmp_path / "g"))
    assert [r.midblock for r in nodes.orderBy("node").collect()] == [False, True] and arcs.first().cost == 7.25
    (tmp_path / "p").write_text("5\n7 2.5\n")
    assert [(r.node, r.demand) for r in text.read_points(spark, str(tmp_path / "p")).orderBy("poi").collect()] == [(5, 1.0), (7, 2.5)]
    (tmp_path / "d.csv").write_text("lon,lat,demand\n1,2,\n3,4,0\n5,6,2\n")
    assert [r.demand for r in text.read_demand_csv(spark, str(tmp_path / "d.csv")).orderBy("lon").collect()] == [1.0, 0.0, 2.0]


def test_places_and_segments(spark, tmp_path):
    rows = [(wkb.point_bytes(1.0, 2.0), 0.9), (wkb.point_bytes(3.0, 4.0), None), (wkb.point_bytes(5.0, 6.0), 0.1), (None, 1.0)]
    f = spark.createDataFrame(rows, "geometry binary, confidence double")
    geoparquet.write(f, str(tmp_path / "places"), kinds=("Point",))
    assert sorted(r.lon for r in geoparquet.read_places(spark, str(tmp_path / "places"), 0.5).collect()) == [1.0, 3.0]
    import pyarrow.parquet as pq

    assert b"geo" in pq.read_schema(next((tmp_path / "places").glob("part-*"))).metadata
    line = wkb.line_bytes
    roads = [("road", "residential", line([(0, 0), (0, 0.001)])), ("road", "steps", line([(0, 0), (1, 1)])), ("rail", None, line([(0, 0), (1, 1)])), ("road", "x", line([(9, 9), (9, 9)])), ("road", "x", None), ("road", "x", line([(5, 5), (5, 5.1)])), ("road", "x", line([(0, 0.001), (0, 0.002)]))]
    spark.createDataFrame(roads, "subtype string, class string, geometry binary").write.parquet(str(tmp_path / "s"))
    judged = streets.judged(geoparquet.read_segments(spark, str(tmp_path / "s")))
    assert {r.reason: r.n for r in streets.skip_counts(judged).collect()} == {"class:steps": 1, "subtype:rail": 1, "degenerate-loop": 1, "bad-geometry": 1}
    nodes, edges = streets.street_graph(judged)
    assert nodes.count() == 3 and edges.count() == 2


SMALL = {
    "model_version": 1, "layers": {"streets": {}, "homes": {}}, "couplings": [{"from": "homes", "to": "streets"}],
    "facilities": {"near": {"open_cost": 500, "capacity": {"hard": 2}}, "far": {"open_cost": 2000}}, "cable": {"fixed_cost_per_m": 10, "reuse_factor": 0.25},
}


@pytest.fixture()
def compiled(spark):
    spots = [(0.0, 0.0), (100.0, 0.0), (200.0, 0.0)]
    lonlat = [c.alias(n) for c, n in zip(geo.unproject(F.col("x"), F.col("y")), ("lon", "lat"))]
    nodes = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "node long, x double, y double").select("node", *lonlat)
    arcs = spark.createDataFrame([(0, 0, 1, 100.0), (1, 1, 2, 100.0)], "arc_id long, src_node long, dst_node long, cost double")
    homes = spark.createDataFrame([(i, 20.0 + 40 * i, 10.0, 1.0) for i in range(5)], "poi long, x double, y double, demand double").select("poi", *lonlat, "demand")
    return lambda more={}: model.compile_model(spark, SMALL | more, layers={"streets": (nodes, arcs), "homes": homes})


def test_chain_accounts_for_itself(compiled):
    got = model.solve_chain(compiled(), rounds=2)
    assert got["total_cost"] == pytest.approx(sum(t["cost"] for t in got["tiers"]))
    assert got["total_cost"] <= got["rounds"][0]["total_cost"] + 1e-9
    first, second = got["tiers"]
    assert first["hubs"] >= 3 and second["hubs"] >= 1 and first["reused_m"] == 0
    assert sum(first["problem"].demand) == sum(second["problem"].demand) == 5


def test_edges_are_numbered_by_range_not_in_one_task(compiled, monkeypatch):
    calls, dense = [], model.dense
    monkeypatch.setattr(model, "dense", lambda names, order: calls.append(names.columns) or dense(names, order))
    rows = compiled().edges.orderBy("edge_id").collect()
    assert [r.edge_id for r in rows] == list(range(len(rows)))
    assert len(calls) == 3  # streets, nodes, pieces


def test_flow_model_arcs(compiled):
    c = compiled({"facilities": None, "time_expansion": {"steps": 3}, "commodities": [{"pairs": [{"src": 0, "dst": 2}]}], "objective": {"unserved_penalty": {"per_unit": 9}}, "edge_capacities": [{"where": {"edges": {"layer": "*"}}, "capacity": {"soft": 1, "penalty_per_unit": 5, "max": 4}}]})
    n, arcs, coms = model.flow_tables(c)
    kinds = {r.origin: r["count"] for r in arcs.groupBy("origin").count().collect()}
    edges, nodes = c.edges.count(), c.nodes.count()
    assert kinds == {"street": 4 * edges, "overflow": 4 * edges, "wait": 2 * nodes, "relief": 1} and n == 3 * nodes
    assert sorted(r.arc_id for r in arcs.collect()) == list(range(arcs.count()))


def test_sampled_flow_model(compiled):
    c = compiled({"facilities": None, "time_expansion": {"steps": 4}, "commodities": [{"sampled": {"count": 6, "hubs": 1}, "seed": 5}]})
    n, _, coms = model.flow_tables(c)
    assert coms.count() == 6 and all(r.dst >= n - n // 4 for r in coms.collect())


def test_bad_models(spark):
    with pytest.raises(model.BadModel):
        model.load({"model_version": 2})
    with pytest.raises(model.BadModel):
        model.tier_plan({"facilities": {}}, 0)
