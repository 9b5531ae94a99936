"""Queries over the road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import routing, staging
from plumbline.operators.lineage import cut, released
from plumbline.plans import sql as S
from plumbline.plans.lookup import query
from plumbline.sources.roads import GRAPH_SQL, graph

ORIGINS = [(3,), (17,), (42,)]
ROUNDS = 14


def _open(spark, sf_dir):
    edges, rules, nodes = graph(spark, sf_dir)
    return routing.allowed(edges, rules), nodes


def _relaxed(name: str, start: str, arcs: str, rounds: int = ROUNDS) -> str:
    """CTEs name0..nameN: so many rounds of relaxation from ``start`` (source, node, cost)."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for i in range(rounds):
        out.append(f"{name}{i + 1} AS MATERIALIZED (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM {name}{i} UNION ALL SELECT d.source, a.end_node, d.cost + a.step FROM {name}{i} d JOIN {arcs} a ON a.start_node = d.node) GROUP BY source, node)")
    return ", ".join(out)


ARCS = "arcs AS MATERIALIZED (SELECT start_node, end_node, min(cost) AS step FROM open_edges GROUP BY start_node, end_node)"
SOURCES = S.values("sources", ORIGINS, "source")
SSSP = f"{SOURCES}, {ARCS}, {_relaxed('d', 'SELECT source, source AS node, CAST(0 AS BIGINT) AS cost FROM sources', 'arcs')}"
LAST = f"d{ROUNDS}"


def _sources(spark):
    return spark.createDataFrame(ORIGINS, "source BIGINT")


@query("edge_allowed_anti", f"WITH {GRAPH_SQL} SELECT edge_id, start_node, end_node, cost FROM open_edges")
def edge_allowed_anti(spark, sf_dir):
    return _open(spark, sf_dir)[0].select("edge_id", "start_node", "end_node", "cost")


@query("opposing_edges", f"WITH {GRAPH_SQL} SELECT a.edge_id, min(b.edge_id) AS opposite FROM open_edges a JOIN open_edges b ON a.start_node = b.end_node AND a.end_node = b.start_node GROUP BY a.edge_id")
def opposing_edges(spark, sf_dir):
    return routing.opposing(_open(spark, sf_dir)[0])


@query("incoming_edges", f"WITH {GRAPH_SQL} SELECT end_node AS node, count(*) AS edges_in, min(cost) AS cheapest FROM open_edges GROUP BY end_node")
def incoming_edges(spark, sf_dir):
    return routing.incoming(_open(spark, sf_dir)[0])


@query("sssp_hops", f"WITH {GRAPH_SQL}, {SSSP} SELECT source, node, CAST(cost AS BIGINT) AS cost FROM {LAST}")
def sssp_hops(spark, sf_dir):
    return routing.shortest(_open(spark, sf_dir)[0], _sources(spark))


BACK = f"turned AS MATERIALIZED (SELECT end_node AS start_node, start_node AS end_node, step FROM arcs), {_relaxed('b', 'SELECT source, source AS node, CAST(0 AS BIGINT) AS cost FROM sources', 'turned')}"


@query("landmark_bounds", f"""WITH {GRAPH_SQL}, {SSSP}, {BACK}, l AS (SELECT coalesce(d.source, b.source) AS landmark, coalesce(d.node, b.node) AS node, d.cost AS ahead, b.cost AS back FROM {LAST} d FULL OUTER JOIN b{ROUNDS} b ON d.source = b.source AND d.node = b.node),
p AS (SELECT s_suppkey AS origin, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS target FROM supplier)
SELECT origin, target, CAST(max(greatest(0, coalesce(t.ahead - o.ahead, 0), coalesce(o.back - t.back, 0))) AS BIGINT) AS bound FROM p JOIN l o ON o.node = origin JOIN l t ON t.node = target AND t.landmark = o.landmark GROUP BY origin, target""")
def landmark_bounds(spark, sf_dir):
    edges, nodes = _open(spark, sf_dir)
    edges = cut(edges.select("start_node", "end_node", "cost"))
    n = nodes.agg(F.count("*").alias("n"))
    pairs = nodes.crossJoin(F.broadcast(n)).select(F.col("node_id").alias("origin"), ((F.col("node_id") * 7 + 3) % F.col("n")).alias("target"))  # one row
    return routing.landmark_bounds(pairs, routing.landmark_costs(edges, _sources(spark).withColumnRenamed("source", "source")))


BANNED = "banned AS (SELECT a.edge_id, b.edge_id AS next_edge FROM open_edges a JOIN open_edges b ON b.start_node = a.end_node WHERE (a.edge_id + b.edge_id) % 5 = 0)"
TURNS = f"{BANNED}, steps AS MATERIALIZED (SELECT a.edge_id AS start_node, b.edge_id AS end_node, b.cost AS step FROM open_edges a JOIN open_edges b ON b.start_node = a.end_node WHERE b.end_node <> a.start_node AND NOT EXISTS (SELECT 1 FROM banned x WHERE x.edge_id = a.edge_id AND x.next_edge = b.edge_id))"


@query("turn_restricted_path", f"""WITH {GRAPH_SQL}, {TURNS}, {_relaxed('r', 'SELECT CAST(3 AS BIGINT) AS source, edge_id AS node, cost FROM open_edges WHERE start_node = 3', 'steps', 10)}
SELECT source, e.end_node AS node, CAST(min(r.cost) AS BIGINT) AS cost FROM r10 r JOIN open_edges e ON e.edge_id = r.node GROUP BY source, e.end_node""")
def turn_restricted_path(spark, sf_dir):
    edges, _ = _open(spark, sf_dir)
    a, b = edges.select("edge_id", F.col("end_node").alias("via")), edges.select(F.col("edge_id").alias("next_edge"), F.col("start_node").alias("via"))
    banned = a.join(b, "via").where((F.col("edge_id") + F.col("next_edge")) % 5 == 0).select("edge_id", "next_edge")
    return routing.restricted(edges, banned, _sources(spark).where("source = 3"))


WALKED = f"""pre AS MATERIALIZED (SELECT source, node, edge_id, before FROM (SELECT t.source, t.node, e.edge_id, e.start_node AS before, row_number() OVER (PARTITION BY t.source, t.node ORDER BY e.edge_id) AS k
  FROM {LAST} t JOIN open_edges e ON e.end_node = t.node JOIN {LAST} s ON s.source = t.source AND s.node = e.start_node WHERE s.cost + e.cost = t.cost AND e.cost > 0) WHERE k = 1),
walk AS (SELECT source, node AS target, edge_id, before FROM pre WHERE node <> source UNION ALL SELECT w.source, w.target, p.edge_id, p.before FROM walk w JOIN pre p ON p.source = w.source AND p.node = w.before WHERE w.before <> w.source)"""


def _ways(spark, sf_dir):
    """(edges, nodes, best, steps): the way from each origin to every node it reaches."""
    edges, nodes = _open(spark, sf_dir)
    best = routing.shortest(edges, _sources(spark))
    targets = best.where("node <> source").select("source", F.col("node").alias("target"))
    return edges, nodes, best, routing.paths(edges, best, targets)


@query("path_verify", f"""WITH RECURSIVE {GRAPH_SQL}, {SSSP}, {WALKED} SELECT source, target, count(*) AS edges, CAST(sum(cost) AS BIGINT) AS cost, true AS continuous, true AS cheapest FROM walk JOIN open_edges USING (edge_id) GROUP BY source, target""")
def path_verify(spark, sf_dir):
    """The way from each origin to every node it reaches, checked from the edges."""
    edges, _, best, steps = _ways(spark, sf_dir)
    return routing.verified_paths(steps, edges, best)


@query("route_geometry", f"""WITH RECURSIVE {GRAPH_SQL}, {SSSP}, {WALKED} SELECT source, target, CAST(count(*) + 1 AS INTEGER) AS n_points, round(sum({S.metres('a.lat', 'a.lng', 'b.lat', 'b.lng')}), 3) AS metres, true AS joined
FROM walk JOIN open_edges USING (edge_id) JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node GROUP BY source, target""")
def route_geometry(spark, sf_dir):
    """The shapes along each of these ways, end to end; an edge is straight between its nodes."""
    edges, nodes, _, steps = _ways(spark, sf_dir)
    at = lambda c: nodes.select(F.col("node_id").alias(c), F.struct("lat", "lng").alias(f"{c}_at"))
    shapes = edges.join(at("start_node"), "start_node").join(at("end_node"), "end_node").select("edge_id", F.array("start_node_at", "end_node_at").alias("shape"))
    return routing.joined_shapes(steps, shapes).select("source", "target", F.size("points").alias("n_points"), F.round("metres", 3).alias("metres"), "joined")


# Banned: two or three edges in a row, each the cheapest that leaves its node.
CHEAP = "cheap AS (SELECT start_node AS u, edge_id, end_node AS v FROM (SELECT *, row_number() OVER (PARTITION BY start_node ORDER BY cost, edge_id) AS k FROM open_edges) WHERE k = 1)"
SEQUENCES = f"{CHEAP}, sequences AS (SELECT a.edge_id AS e1, b.edge_id AS e2, CASE WHEN (a.u + a.v) % 2 = 0 THEN c.edge_id END AS e3 FROM cheap a JOIN cheap b ON b.u = a.v JOIN cheap c ON c.u = b.v)"
SEQUENCE_ROUNDS = 18


def _followed(rounds: int) -> str:
    """CTEs t0..tN: rounds of ways, each known by where it came from and its last two edges as far as rules name them."""
    out = ["t0 AS MATERIALIZED (SELECT source, source AS node, CAST(NULL AS BIGINT) AS came, CAST(0 AS BIGINT) AS h1, CAST(0 AS BIGINT) AS h2, CAST(0 AS BIGINT) AS cost FROM sources)"]
    for i in range(rounds):
        out.append(f"""t{i + 1} AS MATERIALIZED (SELECT source, node, came, h1, h2, min(cost) AS cost FROM (SELECT * FROM t{i} UNION ALL
  SELECT d.source, a.end_node, d.node, d.h2, a.own, d.cost + a.step FROM t{i} d JOIN named_arcs a ON a.start_node = d.node AND (d.came IS NULL OR a.end_node <> d.came)
  WHERE NOT EXISTS (SELECT 1 FROM sequences s WHERE s.e2 = a.own AND s.e1 = d.h2 AND s.e3 IS NULL) AND NOT EXISTS (SELECT 1 FROM sequences s WHERE s.e3 = a.own AND s.e2 = d.h2 AND s.e1 = d.h1)) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY source, node, came, h1, h2"))
    return ", ".join(out)


NAMED_ARCS = "named_arcs AS MATERIALIZED (SELECT start_node, end_node, own, min(cost) AS step FROM (SELECT *, CASE WHEN edge_id IN (SELECT e1 FROM sequences UNION ALL SELECT e2 FROM sequences UNION ALL SELECT e3 FROM sequences WHERE e3 IS NOT NULL) THEN edge_id ELSE 0 END AS own FROM open_edges) GROUP BY start_node, end_node, own)"


@query("sequence_restricted_path", f"WITH {GRAPH_SQL}, {SOURCES}, {SEQUENCES}, {NAMED_ARCS}, {_followed(SEQUENCE_ROUNDS)} SELECT source, node, CAST(min(cost) AS BIGINT) AS cost FROM t{SEQUENCE_ROUNDS} GROUP BY source, node")
def sequence_restricted_path(spark, sf_dir):
    """Cheapest ways that never go straight back and hold none of the banned sequences of two or three edges."""
    edges, _ = _open(spark, sf_dir)
    found = spark.sql(f"WITH {SEQUENCES} SELECT * FROM sequences".replace("FROM open_edges", "FROM {open_edges}"), open_edges=edges)
    rules = found.select(F.array_compact(F.array("e1", "e2", "e3")).alias("edges"))
    return routing.sequence_restricted(edges, rules, _sources(spark))


LEVELS = "SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 3 <> 2"


@query("departures", f"""WITH {GRAPH_SQL}, l AS ({LEVELS}), m AS (SELECT a AS node FROM l UNION SELECT b FROM l)
SELECT m.node, edge_id FROM m JOIN open_edges ON start_node // 3 = m.node // 3 WHERE start_node IN (FROM m) UNION ALL SELECT start_node, edge_id FROM open_edges WHERE start_node NOT IN (FROM m)""")
def departures(spark, sf_dir):
    """The edges that leave each node or another level of its junction; three suppliers in a row are one junction."""
    from plumbline.sources.places_view import read

    edges, _ = _open(spark, sf_dir)
    return routing.departures(edges, spark.sql(LEVELS.replace("FROM supplier", "FROM {supplier}"), supplier=read(spark, sf_dir, "supplier")))


@query("graph_audit", f"""WITH {GRAPH_SQL} SELECT 'edges' AS "check", count(*) AS value FROM edges UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'missing_start', count(*) FROM edges WHERE start_node NOT IN (SELECT node_id FROM nodes)
UNION ALL SELECT 'missing_end', count(*) FROM edges WHERE end_node NOT IN (SELECT node_id FROM nodes) UNION ALL SELECT 'loops', count(*) FROM edges WHERE start_node = end_node UNION ALL SELECT 'duplicate_ids', count(*) - count(DISTINCT edge_id) FROM edges""")
def graph_audit(spark, sf_dir):
    edges, _, nodes = graph(spark, sf_dir)
    return routing.audit(edges, nodes)


@query("graph_histograms", f"WITH {GRAPH_SQL} SELECT use, class, speed, count(*) AS n, CAST(sum(length) AS DOUBLE) AS metres FROM edges GROUP BY use, class, speed")
def graph_histograms(spark, sf_dir):
    return graph(spark, sf_dir)[0].groupBy("use", "class", "speed").agg(F.count("*").alias("n"), F.sum("length").alias("metres"))


POINT_SQL = "points AS (SELECT c_custkey AS query_id, 24 + CAST(c_custkey * 7919 % 2600 AS DOUBLE) / 10000 AS lat, -125 + CAST(c_custkey * 104729 % 5900 AS DOUBLE) / 10000 AS lng FROM customer)"
SNAP_SQL = f"""own AS (SELECT edge_id, a.lat AS a_lat, a.lng AS a_lng, b.lat AS b_lat, b.lng AS b_lng FROM open_edges JOIN nodes a ON a.node_id = start_node JOIN nodes b ON b.node_id = end_node WHERE class >= 2),
h AS (SELECT query_id, edge_id, lat, lng, a_lat, a_lng, b_lat, b_lng, (a_lng - lng) * cos(radians(lat)) AS ax, a_lat - lat AS ay, (b_lng - lng) * cos(radians(lat)) - (a_lng - lng) * cos(radians(lat)) AS dx, (b_lat - lat) - (a_lat - lat) AS dy
  FROM points JOIN own ON lat BETWEEN least(a_lat, b_lat) - 0.01 AND greatest(a_lat, b_lat) + 0.01 AND lng BETWEEN least(a_lng, b_lng) - 0.01 AND greatest(a_lng, b_lng) + 0.01),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM h),
m AS (SELECT query_id, edge_id, round({S.metres('lat', 'lng', 'a_lat + (b_lat - a_lat) * t', 'a_lng + (b_lng - a_lng) * t')}, 3) AS metres FROM t)"""


@query("snap_points", f"WITH {GRAPH_SQL}, {POINT_SQL}, {SNAP_SQL} SELECT query_id, edge_id, metres FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY metres, edge_id) AS nth FROM m WHERE metres <= 100) WHERE nth = 1")
def snap_points(spark, sf_dir):
    from plumbline.sources.places_view import read

    edges, nodes = _open(spark, sf_dir)
    edges = cut(edges.select("edge_id", "start_node", "end_node", "class", "shortcut"))
    released(spark)
    points = read(spark, sf_dir, "customer").selectExpr("c_custkey AS query_id", "24 + CAST(c_custkey * 7919 % 2600 AS DOUBLE) / 10000 AS lat", "-125 + CAST(c_custkey * 104729 % 5900 AS DOUBLE) / 10000 AS lng")
    bare = edges.withColumns({"bridge": F.lit(False), "tunnel": F.lit(False)})
    return routing.snapped(points, staging.snap_eligible(bare, edges), nodes)


@query("canonical_nodes", """WITH RECURSIVE l AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 4 <> 3), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT a AS node, a AS other FROM b UNION SELECT w.node, b.b FROM w JOIN b ON b.a = w.other) SELECT node, min(other) AS canonical FROM w GROUP BY node""")
def canonical_nodes(spark, sf_dir):
    from plumbline.sources.places_view import read

    links = read(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 3").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return routing.groups(links)
