"""From script text to a lineage graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.operators import catalog, stars
from headwater.operators.facts import classify_statements, reject_reasons, statement_targets
from headwater.operators.lineage import PARTS, token_links, with_full_names
from headwater.operators.numbering import global_row_number
from headwater.operators.prepare import number_statements, prepare_scripts
from headwater.session import materialize
from headwater.sources.scripts import missing_scripts, read_manifest, scan_script_lines, script_files, split_script_text
from headwater.sources.sinks import replace_folder, write_graph_js


@dataclass(frozen=True)
class LineageResult:
    """``vertices(id, name, full_name, kind, scope, db, tbl)``, ``edges(src, dst, relation)``,
    ``columns(scope, db, tbl, col, first_seq)`` and ``loose(src, n_owners, owner)``.

    What gave nothing is listed as well: ``rejects(stmt_id, seq, reason)`` for statements,
    ``unresolved_stars(src, dst, reason)`` for stars by the full names of their ends, and
    ``missing(file, ord)`` for listed scripts that are not there (None without a list)."""

    vertices: DataFrame
    edges: DataFrame
    columns: DataFrame
    loose: DataFrame
    rejects: DataFrame
    unresolved_stars: DataFrame
    missing: DataFrame | None = None


def _star_vertex(key: str, col: str):
    part = lambda i: F.nullif(F.element_at(F.split(key, "\u0001"), i), F.lit(""))
    return F.struct(part(1).alias("scope"), part(2).alias("db"), part(3).alias("tbl"), F.col(col).alias("col"))


@dataclass(frozen=True)
class LineageState:
    """What a run keeps so that statements can be added later, as stored tables.

    ``links`` (what feeds what, open names with their candidates), ``columns`` (copies of LIKE included), ``likes``, ``loose``
    (how open names were settled), ``pairs`` (tables that take all columns of another), ``owned`` (columns after star
    expansion), ``targets`` and ``rejects``. ``seq`` and ``first_seq`` say which statement came first.
    """

    links: DataFrame
    columns: DataFrame
    likes: DataFrame
    loose: DataFrame
    pairs: DataFrame
    owned: DataFrame
    targets: DataFrame
    rejects: DataFrame


def _table_of(v: str):
    return catalog.table_key(*(F.col(f"{v}.{p}") for p in PARTS[:3]))


def _star_pairs(links: DataFrame) -> DataFrame:
    """``(src_tbl, dst_tbl)``: tables whose star feeds another table's star."""
    ends = catalog.star_edges(links).where("src.tbl is not null and dst.tbl is not null")
    return ends.select(_table_of("src").alias("src_tbl"), _table_of("dst").alias("dst_tbl")).distinct()


def _by_table(columns: DataFrame) -> DataFrame:
    return columns.select(catalog.table_key(F.col("scope"), F.col("db"), F.col("tbl")).alias("tbl"), "col")


def read_lineage(statements: DataFrame, with_else: bool = False, earlier: LineageState | None = None) -> LineageState:
    """The state of ``statements(stmt_id, seq, sql)``, added to an ``earlier`` one if there is one.

    The result is that of one run over all statements, whatever order the batches come in; a statement
    must not be read twice. Only the new statements are cut into tokens. Columns that are new, or known from an
    earlier statement on than before, are copied on by LIKE and walk along stars; of the names that were settled before,
    only those are settled again that such a column could own.
    """
    # Stored, since the facts, the catalog and the targets each read it.
    statements = materialize(statements.select("stmt_id", "seq", "sql"))
    links = materialize(token_links(statements, with_else).distinct())
    seen = catalog.known_columns(links, catalog.declared_columns(statements))
    likes = catalog.like_edges(statements)
    targets, rejects = statement_targets(statements), statement_rejects(statements)
    if earlier is None:
        columns = materialize(catalog.copy_schema_like(materialize(seen), likes))
        loose = materialize(catalog.settle_loose(links, columns))
        pairs = materialize(_star_pairs(links))
        owned = stars.expand_stars(pairs, _by_table(columns)) if not pairs.isEmpty() else _by_table(columns).where("col <> '*'").distinct().withColumn("inherited", F.lit(False))
        return LineageState(links, columns, materialize(likes), loose, pairs, materialize(owned), materialize(targets), materialize(rejects))

    likes = materialize(likes)
    every_like = earlier.likes.unionByName(likes)
    seen = materialize(seen)
    merged = materialize(earlier.columns.unionByName(seen).groupBy(*PARTS).agg(F.min("first_seq").alias("first_seq")))
    sources = likes.select(F.col("source_db").alias("db"), F.col("source_tbl").alias("tbl")).distinct()
    since = catalog.columns_since(seen, earlier.columns).unionByName(merged.join(sources, ["db", "tbl"], "left_semi").select(*PARTS, "first_seq"))
    columns = materialize(catalog.copy_schema_like(merged, every_like, since))
    changed = materialize(catalog.columns_since(columns, earlier.columns))
    again = materialize(catalog.asked_again(earlier.links, changed))
    settled = catalog.settle_loose(again.unionByName(links), columns)
    loose = materialize(earlier.loose.join(again.select("src").distinct(), "src", "left_anti").unionByName(settled))
    found = materialize(_star_pairs(links))
    more = materialize(found.join(earlier.pairs, ["src_tbl", "dst_tbl"], "left_anti"))
    pairs = materialize(earlier.pairs.unionByName(more))
    owned = materialize(stars.expand_more(pairs, _by_table(changed), more, earlier.owned))
    return LineageState(
        materialize(earlier.links.unionByName(links)), columns, materialize(every_like), loose, pairs, owned,
        materialize(earlier.targets.unionByName(targets)), materialize(earlier.rejects.unionByName(rejects)),
    )


def save_state(state: LineageState, folder: str) -> None:
    """Store a state; it replaces what the folder held once all of it is written."""

    def write(fresh: str) -> None:
        for f in fields(LineageState):
            getattr(state, f.name).write.parquet(f"{fresh}/{f.name}")

    replace_folder(state.links.sparkSession, folder, write)


def load_state(spark: SparkSession, folder: str) -> LineageState:
    return LineageState(*(spark.read.parquet(f"{folder}/{f.name}") for f in fields(LineageState)))


def _star_vertex(key: str, col: str):
    part = lambda i: F.nullif(F.element_at(F.split(key, "\u0001"), i), F.lit(""))
    return F.struct(part(1).alias("scope"), part(2).alias("db"), part(3).alias("tbl"), F.col(col).alias("col"))


def unresolved_stars(links: DataFrame) -> DataFrame:
    """``(src, dst, reason)``: star links with an end that is no table, and those into a table whose star never becomes free."""
    found = catalog.star_edges(links)
    loose_end = F.col("src.tbl").isNull() | F.col("dst.tbl").isNull()
    key = lambda v: catalog.table_key(*(F.col(f"{v}.{p}") for p in PARTS[:3]))
    tables = materialize(found.where(~loose_end).select("src", "dst", key("src").alias("src_tbl"), key("dst").alias("dst_tbl")))
    bound = stars.unresolvable_stars(tables.select("src_tbl", "dst_tbl")).select(F.col("tbl").alias("dst_tbl"))
    cyclic = tables.join(bound, "dst_tbl", "left_semi").select("src", "dst", F.lit("cycle").alias("reason"))
    # A star that is read and goes nowhere: no later part of its statement takes its columns.
    dropped = links.where("src.col = '*' AND (dst IS NULL OR dst.col IS NULL OR dst.col <> '*')").select("src", "dst", F.lit("not passed on").alias("reason"))
    every = found.where(loose_end).select("src", "dst", F.lit("no table").alias("reason")).unionByName(cyclic).unionByName(dropped)
    return with_full_names(every.distinct()).select("src", "dst", "reason")


def statement_rejects(statements: DataFrame) -> DataFrame:
    """``(stmt_id, seq, reason)`` of the statements that give no lineage though they are no plain command."""
    return reject_reasons(classify_statements(statements)).where("reject IS NOT NULL").select("stmt_id", "seq", F.col("reject").alias("reason"))


def lineage_from_statements(statements: DataFrame, with_else: bool = False) -> LineageResult:
    """Lineage of ``statements(stmt_id, seq, sql)``, all in one catalog, ``seq`` giving the order."""
    return lineage_result(read_lineage(statements, with_else))


def lineage_result(state: LineageState) -> LineageResult:
    """The graph of a state: settled names and expanded stars in place of the open ones."""
    columns, targets = state.columns, state.targets
    settled = catalog.apply_settled(state.links, state.loose)
    is_star = (F.col("src.col") == "*") | F.coalesce(F.col("dst.col") == "*", F.lit(False))
    kept = settled.where(~F.coalesce(is_star, F.lit(False))).select("src", "dst")
    made = stars.star_column_edges(state.pairs, state.owned)
    flows = materialize(kept.union(made.select(_star_vertex("src_tbl", "col").alias("src"), _star_vertex("dst_tbl", "col").alias("dst"))).distinct())

    scope = F.concat(F.lit("#"), F.col("stmt_id").cast("string"))
    none = F.lit(None).cast("string").alias("col")
    table = lambda db, tbl: F.struct(F.when(F.col(db).isNull(), scope).alias("scope"), F.col(db).alias("db"), F.col(tbl).alias("tbl"), none)
    mentioned = (
        flows.select(F.explode(F.array("src", "dst")).alias("v"))
        .union(columns.where("col <> '*'").select(F.struct(*PARTS).alias("v")))
        .union(settled.where("src.col = '*' and src.tbl is not null").select(F.struct("src.scope", "src.db", "src.tbl", none).alias("v")))
        .union(targets.select(table("db", "tbl").alias("v")))
        .union(targets.where("source_tbl is not null").select(table("source_db", "source_tbl").alias("v")))
        .where("v is not null")
    )
    vertices = materialize(catalog.catalog_vertices(mentioned))
    used = (
        flows.where("dst is not null and src.col is not null")
        .select(catalog.vertex_id("src").alias("src"), catalog.vertex_id("dst").alias("dst"), F.lit("used for").alias("relation"))
        .distinct()
    )
    edges = catalog.contains_edges(vertices).unionByName(used)
    return LineageResult(vertices, edges, columns, state.loose, state.rejects, unresolved_stars(settled))


def lineage_from_sql(spark: SparkSession, sqls: Iterable[str], with_else: bool = False) -> LineageResult:
    """Lineage of statements given as text, each of one or more lines, in the order given."""
    texts = spark.createDataFrame([(i, text) for i, text in enumerate(sqls)], "ord bigint, body string")
    lines = split_script_text(texts.withColumn("file", F.col("ord").cast("string")))
    statements = prepare_scripts(lines).withColumn("ord", F.col("file").cast("bigint"))
    return lineage_from_statements(number_statements(statements), with_else)


def lineage_from_files(spark: SparkSession, paths: str | Iterable[str], manifest: DataFrame | None = None, root: str | None = None) -> LineageResult:
    """Lineage of script files; ``manifest(file, ord)`` picks and orders them, else their names do.

    Names are paths below ``root``, or whole paths without one. Scripts are cut into
    statements before they meet the manifest: there is one row per statement to join then, and
    none of the steps before it gathers a script.
    """
    prepared = prepare_scripts(scan_script_lines(spark, paths, root))
    missing = None
    if manifest is None:
        prepared = materialize(prepared)
        manifest = global_row_number(prepared.select("file").distinct(), ["file"], "ord")
    else:
        missing = missing_scripts(script_files(spark, paths, root), manifest)
    found = lineage_from_statements(number_statements(prepared.join(manifest, "file")))
    return replace(found, missing=missing)


def run_folder(spark: SparkSession, folder: str, out: str, reports: str | None = None) -> LineageResult:
    """Read ``input.conf`` and the scripts it lists under ``sql/``, write the graph to ``out``.

    ``reports``: a folder for what gave nothing, as JSON lines in ``rejects``, ``unresolved_stars``
    and ``missing``.
    """
    manifest = read_manifest(spark, f"{folder}/input.conf")
    result = lineage_from_files(spark, f"{folder}/sql", manifest, f"{folder}/sql")
    write_graph_js(result.vertices, result.edges, out)
    if reports:
        for name in ("rejects", "unresolved_stars", "missing"):
            getattr(result, name).write.mode("overwrite").json(f"{reports}/{name}")
    return result
