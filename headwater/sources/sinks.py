"""Graph output."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators.graph import graph_export_edges, graph_export_nodes
from headwater.operators.numbering import global_row_number
from headwater.session import materialize

# Group names and text frame the graph viewer reads.
GROUPS = {"database": "NFDatabase", "table": "NFTable", "column": "NFColumn"}
JS_HEAD = 'var data={"nodes":['
JS_MIDDLE = '],"edges":['
JS_TAIL = "]}"


def node_json(vertices: DataFrame) -> DataFrame:
    """One JSON text ``{id,label,group}`` per vertex."""
    group = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))[F.col("group")]
    nodes = graph_export_nodes(vertices).withColumn("group", group)
    return nodes.select(F.to_json(F.struct("id", "label", "group")).alias("json"))


def edge_json(edges: DataFrame) -> DataFrame:
    """One JSON text ``{from,to}`` per edge; the relation is not part of the output."""
    return graph_export_edges(edges).select(F.to_json(F.struct("from", "to")).alias("json"))


def with_numeric_ids(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same graph with ids 1, 2, … as the viewer's files have them."""
    numbered = materialize(global_row_number(vertices, ["id"], "number"))
    ids = numbered.select("id", "number")
    end = lambda side: ids.select(F.col("id").alias(side), F.col("number").alias(f"{side}_number"))
    renamed = edges.join(end("src"), "src").join(end("dst"), "dst")
    return (
        numbered.drop("id").withColumnRenamed("number", "id"),
        renamed.select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"), "relation"),
    )


def replace_folder(spark: SparkSession, out: str, write: Callable[[str], None]) -> None:
    """Run ``write`` on a folder beside ``out`` and put that in the place of ``out`` once it is whole.

    A write that fails or is killed leaves ``out`` as it was. What was there before steps aside under a
    name of its own until the new folder stands; a run that was killed between the two renames is
    undone by the next one, which first puts the old folder back.
    """
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    target = path(out.rstrip("/"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    aside = path(f"{out.rstrip('/')}.replaced")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        else:
            _move(fs, aside, target)
    fresh = f"{out.rstrip('/')}.writing-{uuid4().hex}"
    try:
        write(fresh)
        had = fs.exists(target)
        if had:
            _move(fs, target, aside)
        elif target.getParent() is not None:
            fs.mkdirs(target.getParent())
        try:
            _move(fs, path(fresh), target)
        except Exception:
            if had:
                _move(fs, aside, target)
            raise
        if had:
            fs.delete(aside, True)
    finally:
        fs.delete(path(fresh), True)


def _move(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"{old} cannot be renamed to {new}")


def write_graph_tables(vertices: DataFrame, edges: DataFrame, out: str) -> None:
    """Nodes and edges as JSON lines, one folder each below ``out``; both replace what was there at one time."""

    def write(folder: str) -> None:
        node_json(vertices).select(F.col("json").alias("value")).write.text(f"{folder}/nodes")
        edge_json(edges).select(F.col("json").alias("value")).write.text(f"{folder}/edges")

    replace_folder(vertices.sparkSession, out, write)


def write_graph_js(vertices: DataFrame, edges: DataFrame, out: str) -> None:
    """The viewer's ``var data={…}`` text, written in parts by all tasks.

    The part files, put together in the order of their names, are one script. Every node
    and edge but the first carries the comma before it.
    """
    vertices, edges = with_numeric_ids(vertices, edges)
    edges = materialize(global_row_number(edges.select("src", "dst", "relation").distinct(), ["src", "dst", "relation"], "place"))
    comma = lambda place: F.when(F.col(place) > 1, ",").otherwise("")
    group = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))[F.col("kind")]
    node = F.to_json(F.struct("id", F.col("name").alias("label"), group.alias("group")))
    edge = F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to")))
    frame = vertices.sparkSession.createDataFrame([(0, 0, JS_HEAD), (2, 0, JS_MIDDLE), (4, 0, JS_TAIL)], "section int, place bigint, value string")
    body = (
        vertices.select(F.lit(1).alias("section"), F.col("id").alias("place"), F.concat(comma("id"), node).alias("value"))
        .unionByName(edges.select(F.lit(3).alias("section"), "place", F.concat(comma("place"), edge).alias("value")))
        .unionByName(frame)
    )
    replace_folder(vertices.sparkSession, out, body.sort("section", "place").select("value").write.text)
