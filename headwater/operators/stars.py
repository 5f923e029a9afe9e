"""Expansion of ``SELECT *`` once every other column is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.operators.doubling import chain_ends
from headwater.operators.graph import reach
from headwater.session import materialize, materialize_layout, parts_for


def find_stars(columns: DataFrame) -> DataFrame:
    """Columns that are stars, in tables and loose."""
    return columns.where(F.col("col") == "*")


def expand_stars(star_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns every table owns after expansion: ``(tbl, col, inherited)``.

    ``star_edges(src_tbl, dst_tbl)`` says that ``dst_tbl`` takes all columns of ``src_tbl``;
    ``columns(tbl, col)`` are those known before. Columns walk along the edges together, a
    table is entered once per column, so cycles end.
    """
    edges = star_edges.select(F.col("src_tbl").alias("src"), F.col("dst_tbl").alias("dst"))
    seeds = columns.where("col <> '*'").select(F.col("tbl").alias("node"), "col").distinct()
    walked = reach(edges, seeds, "down")
    return walked.select(F.col("node").alias("tbl"), "col", (F.col("hops") > 0).alias("inherited"))


def expand_more(star_edges: DataFrame, columns: DataFrame, more_edges: DataFrame, owned: DataFrame) -> DataFrame:
    """What ``expand_stars`` gives after columns and edges were added to those behind ``owned``, its earlier result.

    ``star_edges`` are all edges; ``columns`` and ``more_edges`` are the added ones. Only columns that a table did not own
    before walk on.
    """
    given = columns.where("col <> '*'").select("tbl", "col").distinct()
    crossed = more_edges.select(F.col("src_tbl").alias("tbl"), "dst_tbl").join(owned.select("tbl", "col"), "tbl").select(F.col("dst_tbl").alias("node"), "col")
    seeds = given.select(F.col("tbl").alias("node"), "col").union(crossed)
    edges = star_edges.select(F.col("src_tbl").alias("src"), F.col("dst_tbl").alias("dst"))
    known = owned.select(F.col("tbl").alias("node"), "col", F.lit(0).alias("hops"))
    walked = reach(edges, seeds, "down", known=known)
    flags = owned.unionByName(walked.select(F.col("node").alias("tbl"), "col", F.lit(True).alias("inherited"))).unionByName(given.withColumn("inherited", F.lit(False)))
    return flags.groupBy("tbl", "col").agg(F.expr("bool_and(inherited)").alias("inherited"))


def star_column_edges(star_edges: DataFrame, owned: DataFrame) -> DataFrame:
    """Column edges that take the place of the star edges."""
    source = owned.select(F.col("tbl").alias("src_tbl"), "col")
    return star_edges.select("src_tbl", "dst_tbl").distinct().join(source, "src_tbl").select("src_tbl", "dst_tbl", "col")


# A round that takes away less than this share of the open stars is followed by one along whole chains.
SLOW_SHARE = 0.1


def unresolvable_stars(star_edges: DataFrame) -> DataFrame:
    """Tables whose star never becomes free: those on a cycle of stars or below one.

    Stars with no open star above them are taken away, round by round; what is left when a
    round takes none away can never be resolved. Once rounds take little, tables with one open star above them are
    followed up to the end of their chain, and if that end is free the whole chain is, however long.
    """
    edges = materialize(star_edges.select(F.col("src_tbl").alias("src"), F.col("dst_tbl").alias("dst")).distinct())
    width = parts_for(edges.sparkSession, edges.count())
    open_edges, size = materialize_layout(edges.repartition(width, "src"), width)
    while size:
        below = open_edges.select(F.col("dst").alias("src")).distinct()
        kept, left = materialize_layout(open_edges.join(below.hint("merge"), "src", "left_semi"), width)
        if left == size:
            break
        if size - left < SLOW_SHARE * size:
            kept, left = materialize_layout(_without_free_chains(kept).repartition(width, "src"), width)
        open_edges, size = kept, left
    return open_edges.select(F.col("dst").alias("tbl")).distinct()


def _without_free_chains(edges: DataFrame) -> DataFrame:
    """Edges less those into tables with one star above each, up to a table with none."""
    above = materialize(edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("src")))
    ends = chain_ends(above.where("n = 1").select(F.col("dst").alias("node"), F.col("src").alias("to")))
    # A chain that ends at a table with several stars above it waits for them; one that never ends is a cycle.
    free = ends.where("end IS NOT NULL").join(above.select(F.col("dst").alias("end")), "end", "left_anti")
    return edges.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
