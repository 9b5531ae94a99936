"""A road graph from order lines: each leads from its supplier to that of the next line of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.places_view import read

LINES = """
SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS edge_id,
  l_suppkey AS start_node,
  lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS end_node,
  l_quantity * 100 AS length, 30 + l_linenumber * 10 AS speed, CAST(l_partkey % 64 AS INT) AS use, CAST(l_partkey % 8 AS INT) AS class,
  CAST(CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 3 END AS INT) AS access, l_returnflag = 'N' AND l_partkey % 11 = 0 AS shortcut, l_partkey % 19 = 0 AS destination
FROM lineitem
"""
EDGES = f"SELECT *, CAST(round(length * 3600 / speed) AS BIGINT) AS cost FROM ({LINES}) WHERE end_node IS NOT NULL AND end_node <> start_node"
RULES = "SELECT edge_id, CAST(edge_id % 7 AS INT) AS type, CAST(edge_id % 600 AS BIGINT) AS value, CAST(edge_id % 4 AS INT) AS modes FROM edges WHERE edge_id % 10 = 3"
NODES = "SELECT s_suppkey AS node_id, 24 + CAST(s_suppkey * 7919 % 260 AS DOUBLE) / 1000 AS lat, -125 + CAST(s_suppkey * 104729 % 590 AS DOUBLE) / 1000 AS lng FROM supplier"
OPEN_SQL = """open_edges AS (
  SELECT * FROM edges e WHERE NOT shortcut AND NOT destination AND access & 1 = 1 AND speed BETWEEN 1 AND 140 AND length > 0 AND use <= 11 AND use NOT IN (3, 7)
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.edge_id = e.edge_id AND CASE r.type WHEN 1 THEN r.value < 190 WHEN 2 THEN r.value < 200 WHEN 3 THEN r.value < 500
    WHEN 4 THEN r.value < 180 WHEN 5 THEN r.value < 110 ELSE r.modes & 1 = 1 END))"""
GRAPH_SQL = f"edges AS MATERIALIZED ({EDGES}), rules AS ({RULES}), nodes AS ({NODES}), {OPEN_SQL}"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, rules, nodes)."""
    edges = spark.sql(EDGES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))
    rules = spark.sql(RULES.replace("FROM edges", "FROM {edges}"), edges=edges)
    nodes = spark.sql(NODES.replace("FROM supplier", "FROM {supplier}"), supplier=read(spark, sf_dir, "supplier"))
    return edges, rules, nodes
