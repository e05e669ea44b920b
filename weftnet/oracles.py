"""DuckDB SQL for the registered network queries that SQL can express."""

from __future__ import annotations

TRADE = """
pairs AS (
  SELECT s_nationkey AS src_node, c_nationkey AS dst_node, min(round(l_extendedprice)::BIGINT) AS cost, sum(l_quantity)::BIGINT AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL),
arcs AS (
  SELECT row_number() OVER (ORDER BY src_node, dst_node) - 1 AS arc_id, src_node, dst_node, cost, qty, qty // 2 AS cap FROM pairs),
nodes AS (SELECT n_nationkey AS node, n_regionkey AS region FROM nation),
coms AS (
  SELECT row_number() OVER (ORDER BY arc_id) - 1 AS k, src_node AS src, dst_node AS dst, qty % 50 + 1 AS demand
  FROM arcs WHERE src_node % 5 = 0),
duals AS (SELECT arc_id, (arc_id % 7)::DOUBLE AS "lambda" FROM arcs),
direct AS (SELECT k, arc_id, dst FROM coms JOIN arcs ON src = src_node AND dst = dst_node),
routes AS (
  SELECT k, arc_id FROM direct UNION ALL
  SELECT k, f.arc_id FROM direct JOIN (SELECT src_node, min(arc_id) AS arc_id FROM arcs GROUP BY src_node) f ON direct.dst = f.src_node),
loads AS (SELECT arc_id, sum(demand)::BIGINT AS load FROM routes JOIN coms USING (k) GROUP BY arc_id),
und AS (
  SELECT least(src_node, dst_node) AS u, greatest(src_node, dst_node) AS v, arg_min(cost, arc_id) AS len_m
  FROM arcs GROUP BY ALL)
"""

SPLICE = (
    TRADE
    + """,
used AS (SELECT * FROM und WHERE len_m % 3 = 0),
ends AS (SELECT u AS node FROM used UNION ALL SELECT v FROM used),
sp AS (
  SELECT node, count(*) AS degree, count(*) - 2 AS branches FROM ends
  WHERE node NOT IN (SELECT min(node) FROM nodes GROUP BY region) GROUP BY node HAVING count(*) >= 3)
"""
)

EXPANDED = (
    TRADE
    + """,
te AS (
  SELECT t::INT AS t, src_node, dst_node, cost, cap, kind FROM (
    SELECT src_node, dst_node, cost::DOUBLE AS cost, cap::DOUBLE AS cap, 'street' AS kind FROM arcs UNION ALL
    SELECT node, node, 0.01::DOUBLE, NULL, 'wait' FROM nodes) CROSS JOIN range(5) r(t))
"""
)


def levels(cost: str, last: str) -> str:
    """Five relaxation levels over arcs and waiting, each with the last arc taken."""
    out = [TRADE, f", ways AS (SELECT arc_id, src_node, dst_node, {cost} AS cost FROM arcs JOIN duals USING (arc_id) UNION ALL SELECT -1 - node, node, node, 0 FROM nodes),"]
    out.append("d0 AS (SELECT node AS source, node, 0 AS dist, NULL::BIGINT AS arc_id FROM nodes)")
    for k in range(1, 6):
        out.append(f""", d{k} AS (
  SELECT source, node, b.dist AS dist, b.arc_id AS arc_id FROM (
    SELECT source, dst_node AS node, min({{'dist': dist + cost, 'arc_id': ways.arc_id}}) AS b
    FROM d{k - 1} JOIN ways ON d{k - 1}.node = ways.src_node GROUP BY ALL))""")
    return "WITH " + "".join(out) + last


def hops(src: str, dst: str) -> str:
    return f"""WITH RECURSIVE {TRADE},
st AS (SELECT DISTINCT {src} AS a, {dst} AS b FROM arcs WHERE cost % 5 = 0),
walk AS (
  SELECT node AS source, node, 0 AS hops FROM nodes UNION
  SELECT source, b, hops + 1 FROM walk JOIN st ON walk.node = st.a WHERE hops < 6),
hop AS (SELECT source, node, min(hops) AS hops FROM walk GROUP BY ALL)
"""


COMPONENTS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT l_suppkey * 2 AS u, l_partkey * 2 + 1 AS v FROM lineitem WHERE (l_suppkey * 2 + l_partkey * 2 + 1) % 37 = 0),
w AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e),
r AS (SELECT a AS node, a AS seen FROM w UNION SELECT r.node, w.b FROM r JOIN w ON r.seen = w.a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
"""

FOREST = f"""
WITH RECURSIVE {TRADE},
hubs AS (SELECT node FROM nodes WHERE node % 11 = 0),
leaves AS (SELECT node FROM nodes WHERE node % 4 = 3 AND node % 11 <> 0),
inn AS (SELECT src_node, dst_node, cost FROM arcs WHERE src_node NOT IN (SELECT node FROM leaves)),
walk AS (
  SELECT node, 0::BIGINT AS dist, node AS hub, NULL::INT AS parent, 0 AS n FROM hubs UNION ALL
  SELECT x.* FROM (
    SELECT i.dst_node, min(walk.dist + i.cost), arg_min(walk.hub, {{'d': walk.dist + i.cost, 'h': walk.hub, 'p': walk.node}}),
      arg_min(walk.node, {{'d': walk.dist + i.cost, 'h': walk.hub, 'p': walk.node}}), max(n) + 1
    FROM walk JOIN inn i ON walk.node = i.src_node WHERE n < 8 GROUP BY i.dst_node) x),
forest AS (
  SELECT node, b.dist AS dist, b.hub AS hub, b.parent AS parent FROM (
    SELECT node, min({{'dist': dist, 'hub': hub, 'parent': coalesce(parent, -1)}}) AS b FROM walk GROUP BY node)),
f AS (SELECT node, dist, hub, nullif(parent, -1) AS parent FROM forest)
"""

ABOVE = """,
up AS (
  SELECT node, node AS here FROM f UNION ALL
  SELECT up.node, f.parent FROM up JOIN f ON up.here = f.node WHERE f.parent IS NOT NULL),
sub AS (SELECT here AS node, sum(node % 5 + 1)::BIGINT AS load FROM up GROUP BY here)
"""

PLANAR = """
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, label FROM embeddings),
s AS (
  SELECT * FROM (
    SELECT id AS edge_id, id AS u, lead(id) OVER w AS v, x AS ux, y AS uy, lead(x) OVER w AS vx, lead(y) OVER w AS vy
    FROM p WHERE label >= 5 WINDOW w AS (PARTITION BY label ORDER BY id)) WHERE v IS NOT NULL),
sl AS (SELECT *, sqrt((vx - ux) ** 2 + (vy - uy) ** 2) AS len_m FROM s),
d AS (SELECT id AS poi, x, y, (label + 1)::DOUBLE AS demand, label FROM p WHERE label <= 4),
k AS (
  SELECT d.*, sl.*, CASE WHEN len_m > 0 THEN least(greatest(((x - ux) * (vx - ux) + (y - uy) * (vy - uy)) / ((vx - ux) ** 2 + (vy - uy) ** 2), 0), 1) ELSE 0 END AS t
  FROM d CROSS JOIN sl),
q AS (SELECT *, sqrt((x - (ux + t * (vx - ux))) ** 2 + (y - (uy + t * (vy - uy))) ** 2) AS dist FROM k),
near AS (
  SELECT *, CASE WHEN (vx - ux) * (y - uy) - (vy - uy) * (x - ux) >= 0 THEN 1 ELSE -1 END AS side
  FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY dist, edge_id) AS r FROM q) WHERE r = 1)
"""

EVENTS = """
WITH e AS (
  SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS t, user_id AS k, sum(floor(value))::BIGINT AS qty FROM events GROUP BY ALL),
f AS (SELECT t, k % 25 AS src_node, (k * 7 + t) % 25 AS dst_node, qty::DOUBLE AS flow FROM e)
"""

SLOPES = (
    TRADE
    + """,
sl AS (
  SELECT a.arc_id, "lambda",
    (CASE WHEN "lambda" <= 0 AND coalesce(load, 0) - cap // 20 < 0 THEN 0 ELSE coalesce(load, 0) - cap // 20 END)::DOUBLE AS grad
  FROM arcs a LEFT JOIN loads USING (arc_id) JOIN duals USING (arc_id))
"""
)

SQL = {
    "arc_table": f"WITH {TRADE} SELECT * FROM arcs",
    "undirected_dedup": f"WITH {TRADE} SELECT * FROM und",
    "supply_graph": """
      WITH e AS (SELECT DISTINCT l_suppkey * 2 AS u, l_partkey * 2 + 1 AS v FROM lineitem),
      d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node)
      SELECT degree, count(*) AS nodes FROM d GROUP BY degree""",
    "degree_splice": f"WITH {SPLICE} SELECT * FROM sp",
    "splice_charge": f"""WITH {SPLICE}
      SELECT sum(branches)::BIGINT AS branches, sum(branches * (node % 2))::BIGINT AS mid_branches,
        (sum(branches) * 500 + sum(branches * (node % 2)) * 100)::DOUBLE AS cost FROM sp""",
    "time_expand_counts": f"WITH {EXPANDED} SELECT t, kind, count(*) AS arcs, sum(cost) AS cost FROM te GROUP BY ALL",
    "soft_overflow_arcs": f"""WITH {EXPANDED} SELECT * FROM te UNION ALL
      SELECT t, src_node, dst_node, cost + 200, cap * 2, 'overflow' FROM te WHERE cap IS NOT NULL""",
    "relief_arcs": f"WITH {TRADE} SELECT k, src, dst, 0 AS t_from, 5 AS t_to, 1000::DOUBLE AS cost FROM coms",
    "te_shortest_path": levels("cost", " SELECT source, node, dist::BIGINT AS dist FROM d5"),
    "te_shortest_path_parent": levels("cost", " SELECT source, node, arc_id FROM d5"),
    "bfs_hops": hops("src_node", "dst_node") + "SELECT * FROM hop",
    "reachable_sources": hops("dst_node", "src_node") + "SELECT source AS dst, node AS src FROM hop WHERE hops BETWEEN 1 AND 2",
    "components_largest": COMPONENTS + "SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
    "component_sizes": COMPONENTS + "SELECT component, count(*) AS nodes FROM c GROUP BY component",
    "reduced_cost": f'WITH {TRADE} SELECT arc_id, cost + 3 * "lambda" AS reduced_cost FROM arcs JOIN duals USING (arc_id)',
    "arc_load": f"WITH {TRADE} SELECT * FROM loads",
    "dual_bound": levels(
        'cost + "lambda"',
        """ SELECT ((SELECT sum(demand * dist) FROM coms JOIN d5 ON src = source AND dst = node)
          - (SELECT sum("lambda" * cap) FROM arcs JOIN duals USING (arc_id)))::DOUBLE AS lb""",
    ),
    "dual_gradient": f"WITH {SLOPES} SELECT * FROM sl",
    "polyak_step": f"""WITH {SLOPES}
      SELECT arc_id, greatest(0, "lambda" + 1.5::DOUBLE * 4000 / (SELECT sum(grad * grad) FROM sl) * grad) AS "lambda" FROM sl""",
    "max_overload": f"WITH {TRADE} SELECT max(coalesce(load, 0) / cap)::DOUBLE AS overload FROM arcs LEFT JOIN loads USING (arc_id) WHERE cap > 0",
    "capacity_resolution": f"""WITH {TRADE},
      e AS (SELECT arc_id AS edge_id, CASE WHEN src_node % 3 = 0 THEN 'other' WHEN arc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS layer FROM arcs)
      SELECT edge_id, layer, CASE WHEN layer = 'even' THEN 'soft' ELSE 'hard' END AS kind,
        CASE layer WHEN 'even' THEN 20 WHEN 'odd' THEN 7 ELSE 100 END::DOUBLE AS cap,
        CASE WHEN layer = 'even' THEN 200 END::DOUBLE AS penalty, CASE WHEN layer = 'even' THEN 60 END::DOUBLE AS max_cap FROM e""",
    "nearest_hub_forest": FOREST + "SELECT * FROM f",
    "subtree_load": FOREST + ABOVE + "SELECT * FROM sub",
    "served_per_hub": FOREST + "SELECT hub, sum(CASE WHEN node % 2 = 0 THEN node % 5 + 1 ELSE 1 END)::BIGINT AS served FROM f GROUP BY hub",
    "prune_candidates": FOREST + """SELECT hub, sum(CASE WHEN node % 2 = 0 THEN node % 5 + 1 ELSE 1 END)::BIGINT AS served FROM f
      GROUP BY hub ORDER BY served, hub LIMIT 2""",
    "relief_topk": FOREST + ABOVE + """, over AS (SELECT sub.* FROM sub JOIN f USING (node) WHERE f.parent IS NOT NULL AND load > 3)
      SELECT node, load FROM over WHERE node NOT IN (
        SELECT up.node FROM up JOIN over o ON up.here = o.node WHERE up.here <> up.node)
      ORDER BY load DESC, node DESC LIMIT greatest(1, least(1024, (SELECT count(*) // 4 FROM over)))""",
    "nearest_edge": PLANAR + "SELECT poi, edge_id, round(t, 6) AS t, round(dist, 6) AS dist FROM near",
    "side_of_street": PLANAR + "SELECT poi, side FROM near",
    "drop_quantiles": PLANAR + """SELECT round(quantile_cont(dist, 0.5), 6) AS median, round(quantile_cont(dist, 0.95), 6) AS p95,
      round(avg(dist), 6) AS mean, round(max(dist), 6) AS longest FROM near""",
    "drop_limit": PLANAR + "SELECT count_if(dist <= 20)::BIGINT AS kept, count_if(dist > 20)::BIGINT AS skipped FROM near",
    "edge_split_lengths": PLANAR + "SELECT edge_id, round(len_m, 6) AS len_m FROM sl",
    "project_xy": PLANAR + """SELECT id, round((-122.4 + x / 1e5) * (111320.0::DOUBLE * cos(radians(37.77))), 4) AS px,
      round((37.77 + y / 1e5) * 110540.0::DOUBLE, 4) AS py FROM p""",
    "haversine_length": PLANAR + """, g AS (
      SELECT edge_id, radians(vy - uy) / 1e5 / 2 AS dy, radians(vx - ux) / 1e5 / 2 AS dx, radians(37.77 + uy / 1e5) AS a, radians(37.77 + vy / 1e5) AS b FROM s)
      SELECT edge_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(sin(dy) ** 2 + cos(a) * cos(b) * sin(dx) ** 2)), 5) AS meters FROM g""",
    "kmeans_round": PLANAR + """, c AS (SELECT poi AS c, x AS cx, y AS cy FROM d ORDER BY poi LIMIT 8),
      a AS (SELECT poi, x, y, c, row_number() OVER (PARTITION BY poi ORDER BY (x - cx) ** 2 + (y - cy) ** 2, c) AS r FROM d CROSS JOIN c)
      SELECT c AS centre, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS points FROM a WHERE r = 1 GROUP BY c""",
    "recenter": PLANAR + """, m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM d GROUP BY label),
      a AS (SELECT m.label, p.id, row_number() OVER (PARTITION BY m.label ORDER BY round((x - cx) ** 2 + (y - cy) ** 2, 6), id) AS r
        FROM p CROSS JOIN m WHERE p.label >= 5)
      SELECT label AS hub, id AS site FROM a WHERE r = 1""",
    "commodity_order": f"WITH {TRADE} SELECT k, demand, row_number() OVER (ORDER BY demand DESC, k) AS place FROM coms",
    "flow_rollup": EVENTS + """SELECT least(src_node, dst_node) AS u, greatest(src_node, dst_node) AS v, sum(flow) AS flow
      FROM f WHERE flow > 1e-9 AND src_node <> dst_node GROUP BY ALL""",
    "wait_flow": EVENTS + "SELECT src_node AS node, sum(flow) AS flow FROM f WHERE flow > 1e-9 AND src_node = dst_node GROUP BY ALL",
    "flow_cost_check": f"WITH {TRADE} SELECT sum(load * cost)::DOUBLE AS cost FROM loads JOIN arcs USING (arc_id)",
    "duct_reuse": f"""WITH {TRADE}, t AS (
        SELECT coalesce(sum(len_m) FILTER (WHERE len_m % 3 <> 0), 0)::DOUBLE AS new_m, coalesce(sum(len_m) FILTER (WHERE len_m % 3 = 0), 0)::DOUBLE AS reused_m
        FROM und WHERE len_m % 2 = 0)
      SELECT new_m, reused_m, new_m + 0.25 * reused_m AS charged_m FROM t""",
    "systematic_subsample": PLANAR + """, n AS (SELECT poi, row_number() OVER (ORDER BY poi) - 1 AS i FROM d),
      w AS (SELECT floor(k * ((SELECT count(*) FROM d) / 60.0::DOUBLE))::INT AS i FROM range(60) r(k))
      SELECT poi FROM n SEMI JOIN w USING (i)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
