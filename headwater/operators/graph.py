"""Questions asked of a lineage graph ``vertices(id, …)``, ``edges(src, dst, …)``."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.doubling import chain_ends
from headwater.operators.skew import HOT_ROWS, hot_of, replicate, spread
from headwater.session import materialize, materialize_layout, parts_for

# A frontier is broadcast only while its counted rows stay below this.
FRONTIER_BROADCAST_ROWS = 200_000
# Stored pieces of the visited set are merged after this many rounds.
MERGE_EVERY = 16
# Rounds after which chains are looked for: shallow graphs never get there.
CHAINS_AFTER = 20


def triplets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Every edge with the attributes of both its ends."""
    end = lambda side: vertices.select(
        F.col("id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in vertices.columns if c != "id")
    )
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def find_by_full_name(vertices: DataFrame, name: str) -> DataFrame:
    """Number of vertices with exactly this full name."""
    return vertices.where(F.col("full_name") == name).agg(F.count("*").alias("n_vertices"))


def are_linked(vertices: DataFrame, edges: DataFrame, src_name: str, dst_name: str, relation: str = "used for") -> DataFrame:
    """Whether an edge of this relation runs between two full names.

    Both names are looked up before any edge is, so only edges at their vertices are joined.
    """
    ids = lambda name, side: vertices.where(F.col("full_name") == name).select(F.col("id").alias(side))
    found = (
        edges.where(F.col("relation") == relation)
        .join(ids(src_name, "src"), "src", "left_semi")
        .join(ids(dst_name, "dst"), "dst", "left_semi")
    )
    return found.agg((F.count("*") >= 1).alias("linked"))


def root_nodes(vertices: DataFrame) -> DataFrame:
    return vertices.where(F.col("kind") == "database")


def _turned(edges: DataFrame, direction: str) -> DataFrame:
    near, far = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.select(F.col(near).alias("near"), F.col(far).alias("far"))


def one_hop(edges: DataFrame, seeds: DataFrame, direction: str) -> DataFrame:
    """Distinct edges that leave (``down``) or reach (``up``) a seed ``node``."""
    key = "src" if direction == "down" else "dst"
    touched = edges.select("src", "dst").join(seeds.select(F.col("node").alias(key)).distinct(), key, "left_semi")
    return touched.select("src", "dst").distinct()


def both_one_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return one_hop(edges, seeds, "down").union(one_hop(edges, seeds, "up")).distinct()


def edge_lookup(edges: DataFrame, src, dst) -> DataFrame:
    """The edge between two nodes, once however often it is stored."""
    return edges.where((F.col("src") == src) & (F.col("dst") == dst)).select("src", "dst").distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst"])


def unary_chains(turned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, head, place)`` of the nodes that one edge enters and one leaves, and ``(head, length, beyond)`` of their chains.

    A chain begins at its head (place 0) and the edge behind its last node leads ``beyond`` it. Rings of such nodes have no head
    and are left out.
    """
    edges = turned.where("near <> far").distinct()
    out = edges.groupBy(F.col("near").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("far").alias("far"))
    into = edges.groupBy(F.col("far").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("near").alias("near"))
    looped = turned.where("near = far").select(F.col("near").alias("node"))
    inner = materialize(out.where("n_out = 1").join(into.where("n_in = 1"), "node").join(looped, "node", "left_anti").select("node", "near", "far"))
    within = inner.join(inner.select(F.col("node").alias("near")), "near", "left_semi")
    ends = chain_ends(within.select("node", F.col("near").alias("to")))
    heads = inner.join(within.select("node"), "node", "left_anti").select("node", F.col("node").alias("head"), F.lit(0).cast("bigint").alias("place"))
    members = materialize(heads.unionByName(ends.where("end IS NOT NULL").select("node", F.col("end").alias("head"), F.col("steps").alias("place"))))
    last = members.join(inner.select("node", "far"), "node").groupBy("head").agg((F.max("place") + 1).alias("length"), F.max_by("far", "place").alias("beyond"))
    return members, materialize(last)


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "down", at_least: int = HOT_ROWS, known: DataFrame | None = None) -> DataFrame:
    """All nodes that can be reached from the seeds, the seeds included, as ``(node, …, hops)``.

    ``seeds`` has ``node`` and any further columns, which travel along unchanged. A node is
    entered once per value of them, so cycles end. Edges are laid out once by their near
    end, hubs spread over several tasks; later rounds only move the frontier. ``known``: rows of an earlier
    result; they are part of this one and are not entered again, and nothing is walked from them.

    After ``CHAINS_AFTER`` rounds chains of nodes without branches are found once, by doubling, and from then on a chain is
    walked in one round: its nodes can only be reached through each other, so their hops are known, and what lies beyond
    it is entered in the round of its own hops.
    """
    load = [c for c in seeds.columns if c != "node"]
    keys = ["node", *load]

    spark = edges.sparkSession
    turned = _turned(edges, direction)
    degrees = materialize(turned.groupBy("near").agg(F.count("*").alias("n")))
    hot = hot_of(degrees, "near", at_least)
    n_hot = hot.count()
    rows = degrees.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # What travels along multiplies the visited rows; a table seldom has fewer columns than this.
    width = parts_for(spark, (rows + seeds.count()) * 16 if load else rows)
    salted = spread(turned, hot, "near", "far") if n_hot else turned.withColumn("salt", F.lit(0))
    laid_out, _ = materialize_layout(salted.repartition(width, "near", "salt"), width)
    hot_nodes = hot.withColumnRenamed("near", "node")

    # Distinct rows come out partitioned by all their columns but ``hops``, the layout the
    # visited rows are stored in, so a round shuffles the newly met rows and nothing else.
    entered = seeds.select(*keys).distinct()
    seen: list[DataFrame] = []
    if known is not None:
        seen.append(materialize_layout(known.select(*keys, "hops").repartition(width, *keys), width)[0])
    chains, later, hops = None, None, 0

    def unseen(rows: DataFrame) -> DataFrame:
        return rows.join(reduce(DataFrame.union, [s.select(*keys) for s in seen]).hint("merge"), keys, "left_anti") if seen else rows

    for turn in count():
        frontier, size = materialize_layout(unseen(entered).withColumn("hops", F.lit(hops)), width)
        seen.append(frontier)
        if not size and later is None:
            return reduce(DataFrame.union, seen)
        if len(seen) > MERGE_EVERY:
            seen = [materialize_layout(reduce(DataFrame.union, seen), width)[0]]
        if turn == CHAINS_AFTER:
            chains = unary_chains(turned)
        nodes = frontier.select(*keys)
        if chains is not None and size:
            members, ends = chains
            at = materialize(nodes.join(members, "node"))
            nodes = nodes.join(members.select("node"), "node", "left_anti")
            starts = at.select(F.col("place").alias("from"), "head", *load)
            walked = starts.join(members, "head").where("place > from").withColumn("hops", (F.col("place") - F.col("from") + hops).cast("int"))
            jumped, _ = materialize_layout(unseen(walked.groupBy(*keys).agg(F.min("hops").alias("hops"))), width)
            beyond = starts.join(ends, "head").select(F.col("beyond").alias("node"), *load, (F.col("length") - F.col("from") + hops).cast("int").alias("hops"))
            later = materialize((beyond if later is None else beyond.unionByName(later)).groupBy(*keys).agg(F.min("hops").alias("hops")))
            seen.append(jumped)
        if size <= FRONTIER_BROADCAST_ROWS:
            met = laid_out.join(F.broadcast(nodes.withColumnRenamed("node", "near")), "near")
        else:
            start = replicate(nodes, hot_nodes, "node") if n_hot else nodes.withColumn("salt", F.lit(0))
            met = laid_out.join(start.withColumnRenamed("node", "near"), ["near", "salt"])
        entered = met.select(F.col("far").alias("node"), *load).distinct()
        hops += 1
        if later is not None:
            entered = materialize_layout(unseen(entered), width)[0]
            if entered.isEmpty():
                hops = max(hops, later.agg(F.coalesce(F.min("hops"), F.lit(0))).first()[0])
            due = later.where(F.col("hops") <= hops).select(*keys)
            entered = entered.union(due).distinct()
            later = materialize(later.where(F.col("hops") > hops))
            later = None if later.isEmpty() else later


def downstream_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return reach(edges, seeds, "down")


def upstream_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return reach(edges, seeds, "up")


def ego_nodes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """A node with everything above and below it: ``(node, side)``, side ``up`` or ``down``."""
    up = upstream_closure(edges, seeds).select("node", F.lit("up").alias("side"))
    down = downstream_closure(edges, seeds).select("node", F.lit("down").alias("side"))
    return up.union(down)


def ego_lineage(vertices: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left in view around the seeds: roots, seeds, all above, all below.

    An edge stays when it was walked: its far end is above a seed or its near end below one.
    """
    sides = materialize(ego_nodes(edges, seeds))
    up, down = (sides.where(F.col("side") == s).select("node") for s in ("up", "down"))
    roots = root_nodes(vertices).select(F.col("id").alias("node"))
    nodes = sides.select("node").union(roots).distinct()
    pairs = edges.select("src", "dst")
    walked = pairs.join(up.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    walked = walked.union(pairs.join(down.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    return nodes, walked.distinct()


def search_with_upstream(vertices: DataFrame, edges: DataFrame, text: str, label: str = "name") -> DataFrame:
    """Vertices whose label holds the text, and everything above them."""
    seeds = vertices.where(F.col(label).contains(text)).select(F.col("id").alias("node"))
    return upstream_closure(edges, seeds)


def table_lineage(column_edges: DataFrame) -> DataFrame:
    """Distinct table pairs behind column edges ``(src_table, dst_table)``."""
    return column_edges.where("src_table <> dst_table").select("src_table", "dst_table").distinct()


def graph_export_nodes(vertices: DataFrame) -> DataFrame:
    return vertices.select("id", F.col("name").alias("label"), F.col("kind").alias("group"))


def graph_export_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("from"), F.col("dst").alias("to"))
