"""Queries over lineage graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import graph
from headwater.plans import fixtures as fx
from headwater.plans.registry import query, table
from headwater.sources import sinks

_GROUP_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in sinks.GROUPS.items()) + " END"


def _last_node(spark, folder):
    """The node a user has selected: the one numbered last."""
    return table(spark, folder, "customer").agg(F.max("c_custkey").alias("node"))


def _first_leaf(spark, folder):
    """The lowest node that takes from another one."""
    return table(spark, folder, "customer").where("c_custkey > 0").agg(F.min("c_custkey").alias("node"))


def _builders(spark, folder):
    return table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node"))


_LAST_SQL = "seed AS (SELECT max(c_custkey) AS node FROM customer)"
_FIRST_SQL = "seed AS (SELECT min(c_custkey) AS node FROM customer WHERE c_custkey > 0)"
_BUILDERS_SQL = "seed AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING')"


def _closure_sql(graph_sql: str, edges: str, seed: str, direction: str) -> str:
    near, far = ("src", "dst") if direction == "down" else ("dst", "src")
    return f"""WITH RECURSIVE {graph_sql}, {seed}, walk AS (SELECT node FROM seed
      UNION SELECT e.{far} FROM walk JOIN {edges} e ON e.{near} = walk.node) SELECT node FROM walk"""


@query("write_graph_json_nodes", f"""WITH {fx.GRAPH_SQL} SELECT concat('{{"id":"', id, '","label":"', name, '","group":"', {_GROUP_SQL}, '"}}') AS json FROM v""")
def write_graph_json_nodes(spark, folder):
    return sinks.node_json(fx.graph_vertices(spark, folder))


@query("write_graph_json_edges", f"""WITH {fx.GRAPH_SQL} SELECT concat('{{"from":"', src, '","to":"', dst, '"}}') AS json FROM e""")
def write_graph_json_edges(spark, folder):
    return sinks.edge_json(fx.graph_edges(spark, folder))


@query(
    "graph_tables",
    f"""WITH {fx.GRAPH_SQL} SELECT 'vertices' AS part, kind, count(*) AS n FROM v GROUP BY kind
        UNION ALL SELECT 'edges', relation, count(*) FROM e GROUP BY relation""",
)
def graph_tables(spark, folder):
    vertices, edges = fx.graph_vertices(spark, folder), fx.graph_edges(spark, folder)
    parts = vertices.groupBy("kind").agg(F.count("*").alias("n")).withColumn("part", F.lit("vertices"))
    return parts.unionByName(edges.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edges")))


@query(
    "triplets",
    f"""WITH {fx.GRAPH_SQL} SELECT src, dst, relation, s.name AS src_name, s.kind AS src_kind, d.name AS dst_name, d.kind AS dst_kind
        FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst""",
)
def triplets(spark, folder):
    return graph.triplets(fx.graph_vertices(spark, folder), fx.graph_edges(spark, folder))


def _named(spark, folder):
    return fx.graph_vertices(spark, folder).withColumn("full_name", F.col("name"))


@query("find_by_full_name", f"WITH {fx.GRAPH_SQL} SELECT count(*) AS n_vertices FROM v WHERE name = 'nation_7'")
def find_by_full_name(spark, folder):
    return graph.find_by_full_name(_named(spark, folder), "nation_7")


@query(
    "are_linked",
    f"""WITH {fx.GRAPH_SQL} SELECT count(*) >= 1 AS linked FROM e JOIN v s ON s.id = src JOIN v d ON d.id = dst
        WHERE relation = 'used for' AND s.name = 'customer#000000014' AND d.name = 'customer#000000004'""",
)
def are_linked(spark, folder):
    return graph.are_linked(_named(spark, folder), fx.graph_edges(spark, folder), "customer#000000014", "customer#000000004")


@query("root_nodes", f"WITH {fx.GRAPH_SQL} SELECT id, name, kind FROM v WHERE kind = 'database'")
def root_nodes(spark, folder):
    return graph.root_nodes(fx.graph_vertices(spark, folder))


_HOP_SEEDS_SQL = _BUILDERS_SQL


@query("downstream_one_hop", f"WITH {fx.TREE_SQL}, {_HOP_SEEDS_SQL} SELECT DISTINCT src, dst FROM tree JOIN seed ON src = node")
def downstream_one_hop(spark, folder):
    return graph.one_hop(fx.tree_edges(spark, folder), _builders(spark, folder), "down")


@query("upstream_one_hop", f"WITH {fx.TREE_SQL}, {_HOP_SEEDS_SQL} SELECT DISTINCT src, dst FROM tree JOIN seed ON dst = node")
def upstream_one_hop(spark, folder):
    return graph.one_hop(fx.tree_edges(spark, folder), _builders(spark, folder), "up")


@query("both_one_hop", f"WITH {fx.TREE_SQL}, {_HOP_SEEDS_SQL} SELECT DISTINCT src, dst FROM tree JOIN seed ON src = node OR dst = node")
def both_one_hop(spark, folder):
    return graph.both_one_hop(fx.tree_edges(spark, folder), _builders(spark, folder))


@query("downstream_closure", _closure_sql(fx.TREE_SQL, "tree", _LAST_SQL, "down"))
def downstream_closure(spark, folder):
    return graph.downstream_closure(fx.tree_edges(spark, folder), _last_node(spark, folder)).select("node")


@query("downstream_closure_cycles", _closure_sql(fx.CYCLE_SQL, "rings", _BUILDERS_SQL, "down"))
def downstream_closure_cycles(spark, folder):
    return graph.downstream_closure(fx.cycle_edges(spark, folder), _builders(spark, folder)).select("node")


@query("upstream_closure", _closure_sql(fx.TREE_SQL, "tree", _FIRST_SQL, "up"))
def upstream_closure(spark, folder):
    return graph.upstream_closure(fx.tree_edges(spark, folder), _first_leaf(spark, folder)).select("node")


@query("upstream_closure_cycles", _closure_sql(fx.CYCLE_SQL, "rings", _BUILDERS_SQL, "up"))
def upstream_closure_cycles(spark, folder):
    return graph.upstream_closure(fx.cycle_edges(spark, folder), _builders(spark, folder)).select("node")


_EGO_SQL = f"""WITH RECURSIVE {fx.GRAPH_SQL}, up AS (SELECT 'c5' AS node UNION SELECT src FROM up JOIN e ON dst = node),
  down AS (SELECT 'c5' AS node UNION SELECT dst FROM down JOIN e ON src = node)"""


def _ego(spark, folder):
    seeds = fx.graph_vertices(spark, folder).where("id = 'c5'").select(F.col("id").alias("node"))
    return graph.ego_lineage(fx.graph_vertices(spark, folder), fx.graph_edges(spark, folder), seeds)


@query("ego_lineage", f"{_EGO_SQL} SELECT node FROM up UNION SELECT node FROM down UNION SELECT id FROM v WHERE kind = 'database'")
def ego_lineage(spark, folder):
    return _ego(spark, folder)[0]


@query(
    "ego_lineage_edges",
    f"""{_EGO_SQL} SELECT DISTINCT src, dst FROM e WHERE dst IN (SELECT node FROM up) OR src IN (SELECT node FROM down)""",
)
def ego_lineage_edges(spark, folder):
    return _ego(spark, folder)[1]


@query(
    "search_with_upstream",
    f"""WITH RECURSIVE {fx.GRAPH_SQL}, walk AS (SELECT id AS node FROM v WHERE contains(name, '0007')
        UNION SELECT src FROM walk JOIN e ON dst = node) SELECT node FROM walk""",
)
def search_with_upstream(spark, folder):
    found = graph.search_with_upstream(fx.graph_vertices(spark, folder), fx.graph_edges(spark, folder), "0007")
    return found.select("node")


@query("edge_lookup", f"WITH {fx.GRAPH_SQL} SELECT DISTINCT src, dst FROM e WHERE src = 'c14' AND dst = 'c4'")
def edge_lookup(spark, folder):
    return graph.edge_lookup(fx.graph_edges(spark, folder), "c14", "c4")


@query("distinct_edges", f"WITH {fx.GRAPH_SQL} SELECT DISTINCT src, dst FROM e")
def distinct_edges(spark, folder):
    return graph.distinct_edges(fx.graph_edges(spark, folder)).select("src", "dst")


@query("graph_export_nodes", f"""WITH {fx.GRAPH_SQL} SELECT id, name AS label, kind AS "group" FROM v""")
def graph_export_nodes(spark, folder):
    return graph.graph_export_nodes(fx.graph_vertices(spark, folder))


@query("graph_export_edges", f"""WITH {fx.GRAPH_SQL} SELECT src AS "from", dst AS "to" FROM e""")
def graph_export_edges(spark, folder):
    return graph.graph_export_edges(fx.graph_edges(spark, folder))
