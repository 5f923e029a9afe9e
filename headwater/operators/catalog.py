"""Databases, tables and columns that a corpus names, and what they are called in a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions.text import full_name
from headwater.operators.blocks import tokenize_statements, with_neighbours, with_openers
from headwater.operators.doubling import spread_down
from headwater.operators.facts import like_statements, schema_statements, select_items, statement_targets
from headwater.operators.lineage import MARK, PARTS, PLACE
from headwater.operators.skew import lookup_join
from headwater.session import materialize, shuffle_width


def table_key(scope: Column, db: Column, tbl: Column) -> Column:
    """One string per table; an absent part stays tellable from any name."""
    return F.concat_ws(MARK, *(F.coalesce(c, F.lit("")) for c in (scope, db, tbl)))


def vertex_id(v: str) -> Column:
    """Identity of a vertex struct: kind, scope and names. No two vertices share one."""
    scope, db, tbl, col = (F.col(f"{v}.{p}") for p in PARTS)
    kind = F.when(col.isNotNull(), "c").when(tbl.isNotNull(), "t").otherwise("d")
    return F.when(F.col(v).isNotNull(), F.concat_ws(":", kind, scope, F.concat_ws(".", db, tbl, col)))


def vertex_kind(v: str) -> Column:
    return F.when(F.col(f"{v}.col").isNotNull(), "column").when(F.col(f"{v}.tbl").isNotNull(), "table").otherwise("database")


def declared_columns(statements: DataFrame) -> DataFrame:
    """``columns(stmt_id, seq, db, tbl, col, pos)`` written out in CREATE TABLE statements, ``pos`` giving their order.

    A column name is the first word of an entry in the bracket that follows the table
    name, or in the one that follows PARTITIONED BY.
    """
    made = schema_statements(statements).selectExpr("stmt_id", "seq", "target_db AS db", "target_tbl AS tbl", "sql")
    spread = made.repartition(shuffle_width(statements.sparkSession), "stmt_id")
    tokens = with_openers(with_neighbours(tokenize_statements(spread)))
    # Commas between angle brackets part the fields of one type.
    angle = "sum(CASE tok WHEN '<' THEN 1 WHEN '>' THEN -1 ELSE 0 END) OVER (PARTITION BY stmt_id ORDER BY pos)"
    tokens = tokens.withColumn("angle", F.expr(angle))
    listed = "open.prev = concat_ws('.', db, tbl) OR (open.prev = 'by' AND open.prev2 = 'partitioned')"
    named = tokens.where(f"level = 1 AND angle = 0 AND kind = 'word' AND prev IN ('(', ',') AND ({listed})")
    return named.selectExpr("stmt_id", "seq", "db", "tbl", "tok AS col", "pos")


def table_schemas(statements: DataFrame) -> DataFrame:
    """``(db, tbl, seq, place, col)``: the columns of tables in their order, from each statement that lays them out.

    CREATE TABLE with columns, CREATE TABLE … AS with a list that has no star, and LIKE, which takes the layout that its
    source has by then. Copies of copies are looked up in rounds until none changes; each has a later ``seq``, so that ends.
    """
    statements = statements.select("stmt_id", "seq", "sql")
    in_order = Window.partitionBy("stmt_id").orderBy("pos")
    declared = declared_columns(statements).withColumn("place", F.row_number().over(in_order) - 1)
    made = statement_targets(statements).where("kind = 'ctas'").select("stmt_id", "db", "tbl")
    items = select_items(statements).where("block_id = -1 AND branch = 0")
    named = items.groupBy("stmt_id").agg(F.collect_list(F.struct(F.col("item_no").alias("place"), F.col("out_name").alias("col"))).alias("items"), F.expr("bool_or(is_star)").alias("star"))
    selected = named.where("NOT star").join(made, "stmt_id").join(statements.select("stmt_id", "seq"), "stmt_id").select("db", "tbl", "seq", F.expr("inline(items)"))
    written = declared.select("db", "tbl", "seq", "place", "col").unionByName(selected).where("db IS NOT NULL")
    layout = F.array_sort(F.collect_list(F.struct("place", "col"))).alias("layout")
    written = materialize(written.groupBy("db", "tbl", "seq").agg(layout))
    likes = materialize(like_edges(statements).where("db IS NOT NULL AND source_db IS NOT NULL").select("db", "tbl", "seq", "source_db", "source_tbl"))
    if likes.isEmpty():
        return written.selectExpr("db", "tbl", "seq", "inline(layout)")
    known, last = written, None
    while True:
        source = known.select(F.col("db").alias("source_db"), F.col("tbl").alias("source_tbl"), F.col("seq").alias("since"), "layout")
        then = likes.join(source, ["source_db", "source_tbl"]).where("since < seq")
        copies = then.groupBy("db", "tbl", "seq").agg(F.max_by("layout", "since").alias("layout"))
        known = materialize(written.unionByName(copies))
        now = known.agg(F.count("*").alias("n"), F.sum(F.xxhash64("db", "tbl", "seq", "layout").cast("decimal(38,0)")).alias("sum")).first()
        if now == last:
            return known.selectExpr("db", "tbl", "seq", "inline(layout)")
        last = now


def place_columns(links: DataFrame, schemas: DataFrame) -> DataFrame:
    """Links read ``by_place`` with real columns: the one at the item's place in the layout in force, else that of the item's name."""
    marked = links.withColumn("told", F.when(F.startswith("dst.col", F.lit(PLACE)), F.split("dst.col", PLACE)))
    asked = materialize(marked.where("told IS NOT NULL").select(F.col("dst.db").alias("db"), F.col("dst.tbl").alias("tbl"), F.col("seq").alias("at"), F.col("told")[1].cast("int").alias("place")).where("db IS NOT NULL").distinct())
    # The layout in force is the last one before the statement.
    laid = asked.select("db", "tbl", "at").distinct().join(schemas.select("db", "tbl", "seq").distinct(), ["db", "tbl"]).where("seq < at").groupBy("db", "tbl", "at").agg(F.max("seq").alias("seq"))
    placed = asked.join(laid, ["db", "tbl", "at"]).join(schemas, ["db", "tbl", "seq", "place"]).select(F.struct("db", "tbl").alias("of"), F.col("at").alias("seq"), "place", F.col("col").alias("placed"))
    named = marked.withColumns({"of": F.struct("dst.db", "dst.tbl"), "place": F.col("told")[1].cast("int")}).join(placed, ["of", "seq", "place"], "left")
    col = F.coalesce("placed", F.col("told")[2], "dst.col").alias("col")
    dst = F.when(F.col("dst").isNotNull(), F.struct("dst.scope", "dst.db", "dst.tbl", col))
    return named.withColumn("dst", dst).select(*links.columns)


def like_edges(statements: DataFrame) -> DataFrame:
    """``(seq, scope, db, tbl, source_db, source_tbl)`` of the CREATE … LIKE statements."""
    return like_statements(statements).select(
        "stmt_id", "seq", F.col("target_db").alias("db"), F.col("target_tbl").alias("tbl"), "source_db", "source_tbl"
    )


def copy_schema_like(columns: DataFrame, likes: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Add the columns that CREATE … LIKE copies: those the source has by then, unlinked.

    A copy may be copied again later. Each statement follows those that made its source before it, and columns
    are carried along these steps by shortcuts of doubled length, so a chain of copies takes as many rounds as the logarithm of its
    length; each step has a later ``seq``, so none goes in a circle. ``since``: the columns to start from, where the copies of
    all others are among ``columns`` already.
    """
    step = likes.where("source_db is not null and db is not null").select(
        F.col("source_db").alias("s_db"), F.col("source_tbl").alias("s_tbl"), "db", "tbl", F.col("seq").alias("like_seq")
    )
    step = materialize(step.distinct().withColumn("node", F.monotonically_increasing_id()))
    if step.isEmpty():
        return columns
    fresh = (columns if since is None else since).where("scope is null and col <> '*'").select(F.col("db").alias("s_db"), F.col("tbl").alias("s_tbl"), "col", "first_seq")
    direct = fresh.join(step, ["s_db", "s_tbl"]).where("first_seq < like_seq").select("node", F.col("col").alias("load"))
    before = step.select(F.col("db").alias("s_db"), F.col("tbl").alias("s_tbl"), F.col("like_seq").alias("made"), F.col("node").alias("before"))
    steps = step.join(before, ["s_db", "s_tbl"]).where("made < like_seq").select("node", "before")
    made = spread_down(direct, steps).join(step, "node")
    copies = made.select(F.lit(None).cast("string").alias("scope"), "db", "tbl", F.col("load").alias("col"), F.col("like_seq").alias("first_seq"))
    return columns.unionByName(copies).groupBy("scope", "db", "tbl", "col").agg(F.min("first_seq").alias("first_seq"))


def known_columns(links: DataFrame, declared: DataFrame) -> DataFrame:
    """``columns(scope, db, tbl, col, first_seq)``: every table column and where it first occurs."""
    ends = links.select(F.explode(F.array(F.when(F.col("candidates").isNull(), F.col("src")), F.col("dst"))).alias("v"), "seq")
    seen = ends.where("v.tbl is not null and v.col is not null").select("v.*", "seq")
    statement = F.concat(F.lit("#"), F.col("stmt_id").cast("string"))
    written = declared.select(F.when(F.col("db").isNull(), statement).alias("scope"), "db", "tbl", "col", "seq")
    return seen.unionByName(written).groupBy(*PARTS).agg(F.min("seq").alias("first_seq"))


def settle_loose(links: DataFrame, columns: DataFrame) -> DataFrame:
    """Outcome for each bare name that several relations could own.

    ``(src, n_owners, owner)``: the relation that is known to have the column by then
    owns it, if it is the only one; otherwise the name stays a loose column.
    """
    asked = links.where("candidates is not null").select("src", "seq", "candidates").distinct()
    asked = materialize(
        asked.select("src", "seq", F.explode("candidates").alias("t"))
        .withColumn("key", F.concat_ws(MARK, table_key(F.col("t.scope"), F.col("t.db"), F.col("t.tbl")), "src.col"))
        .withColumn("asker", F.concat_ws("/", "src.scope", "src.col"))
    )
    known = columns.where("col <> '*'").select(
        F.concat_ws(MARK, table_key(F.col("scope"), F.col("db"), F.col("tbl")), "col").alias("key"), "first_seq"
    )
    found = lookup_join(asked, known, "key", by="asker", how="left")
    has = F.col("first_seq") <= F.col("seq")
    owner = F.struct("t.scope", "t.db", "t.tbl", F.col("src.col").alias("col"))
    outcome = found.groupBy("src").agg(
        F.count(F.when(has, 1)).alias("n_owners"), F.max(F.when(has, owner)).alias("owner")
    )
    return outcome.withColumn("owner", F.when(F.col("n_owners") == 1, F.col("owner")))


def column_key() -> Column:
    """One string per column of ``columns(scope, db, tbl, col)``."""
    return F.concat_ws(MARK, table_key(F.col("scope"), F.col("db"), F.col("tbl")), "col")


def columns_since(columns: DataFrame, before: DataFrame) -> DataFrame:
    """Columns that ``before`` does not have, or has from a later statement on."""
    old = before.select(column_key().alias("key"), F.col("first_seq").alias("old_seq"))
    found = columns.withColumn("key", column_key()).join(old, "key", "left")
    return found.where("old_seq IS NULL OR old_seq > first_seq").drop("key", "old_seq")


def asked_again(links: DataFrame, changed: DataFrame) -> DataFrame:
    """The open links of which a candidate has got its column, by then, among ``changed`` columns."""
    open_ = links.where("candidates IS NOT NULL")
    each = open_.select("src", "seq", F.explode("candidates").alias("t")).withColumn("key", F.concat_ws(MARK, table_key(F.col("t.scope"), F.col("t.db"), F.col("t.tbl")), "src.col"))
    met = each.join(changed.select(column_key().alias("key"), "first_seq"), "key").where("first_seq <= seq")
    return open_.join(met.select("src").distinct(), "src", "left_semi")


def apply_settled(links: DataFrame, settled: DataFrame) -> DataFrame:
    """Links with the settled owners in place of the loose names."""
    sure = links.where("candidates is null").drop("candidates")
    open_ = links.where("candidates is not null").drop("candidates")
    named = open_.join(settled.where("owner is not null").select("src", "owner"), "src", "left")
    return sure.unionByName(named.withColumn("src", F.coalesce("owner", "src")).drop("owner"))


def star_edges(links: DataFrame) -> DataFrame:
    """``(src, dst)`` of links that pass a whole table on: both ends are stars."""
    return links.where("src.col = '*' and dst.col = '*'").select("src", "dst").distinct()


def contains_edges(vertices: DataFrame) -> DataFrame:
    """Database to table and table to column, from the parts of each vertex."""
    # A table of a database sits in it; a column of a table sits in that.
    tables = vertices.where("kind = 'table' and db is not null")
    columns = vertices.where("kind = 'column' and tbl is not null")
    in_database = tables.select(F.concat(F.lit("d:"), "db").alias("src"), F.col("id").alias("dst"))
    in_table = columns.select(
        F.concat_ws(":", F.lit("t"), "scope", F.concat_ws(".", "db", "tbl")).alias("src"), F.col("id").alias("dst")
    )
    return in_database.unionByName(in_table).withColumn("relation", F.lit("contains"))


def catalog_vertices(mentions: DataFrame) -> DataFrame:
    """``vertices(id, name, full_name, kind, scope, db, tbl)``, each once, from vertex structs ``v``.

    A column brings its table along, a table its database.
    """
    none = F.lit(None).cast("string")
    part = lambda *keep: F.struct(*((F.col(f"v.{p}") if p in keep else none).alias(p) for p in PARTS))
    family = F.array(
        F.col("v"),
        F.when(F.col("v.tbl").isNotNull(), part("scope", "db", "tbl")),
        F.when(F.col("v.db").isNotNull(), part("db")),
    )
    each = mentions.select(F.explode(family).alias("v")).where("v is not null").distinct()
    return each.select(
        vertex_id("v").alias("id"),
        F.coalesce("v.col", "v.tbl", "v.db").alias("name"),
        full_name(F.col("v.db"), F.col("v.tbl"), F.col("v.col")).alias("full_name"),
        vertex_kind("v").alias("kind"),
        F.col("v.scope").alias("scope"),
        F.col("v.db").alias("db"),
        F.col("v.tbl").alias("tbl"),
    )
