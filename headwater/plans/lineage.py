"""Queries over the catalog and the column lineage of statement corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.api import lineage_result, read_lineage, statement_rejects, unresolved_stars
from headwater.functions.text import full_name
from headwater.operators import catalog, prepare, stars
from headwater.operators.facts import source_relations, statement_targets, target_relations
from headwater.operators.graph import table_lineage as distinct_pairs
from headwater.operators.lineage import token_links, with_full_names
from headwater.plans import fixtures as fx
from headwater.plans.registry import query, table

from headwater.session import materialize

_T = "concat('mart.t', o_orderkey)"
_S = "concat('raw.s', o_custkey)"
_H = "concat('mart.t', CAST(floor(o_orderkey / 2) AS BIGINT))"


def _links(df: DataFrame) -> DataFrame:
    return token_links(df.select("stmt_id", "seq", "sql"))


def _column_of(name: str, col: str) -> str:
    return f"concat({name}, '.{col}')"


def _rows(forms: dict[int, list[tuple[str, ...]]], columns: tuple[str, ...], modulo: int = 5, key: str = "o_orderkey", source: str = "orders") -> str:
    """One SELECT per expected row of each statement form, from the form's own key."""
    parts = []
    for form, found in forms.items():
        for row in found:
            named = ", ".join(f"{expr} AS {col}" for expr, col in zip(row, columns))
            parts.append(f"SELECT {key} AS stmt_id, {named} FROM {source} WHERE {key} % {modulo} = {form}")
    return " UNION ALL ".join(parts)


def _unseen() -> str:
    return "CAST(NULL AS STRING)"


@query(
    "catalog_tables",
    f"""SELECT DISTINCT db, tbl FROM (
      SELECT 'mart' AS db, concat('t', o_orderkey) AS tbl FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)
      UNION ALL SELECT 'raw', concat('s', o_custkey) FROM orders WHERE o_orderkey % 5 > 0
      UNION ALL SELECT 'mart', concat('t', CAST(floor(o_orderkey / 2) AS BIGINT)) FROM orders WHERE o_orderkey % 5 = 1)""",
)
def catalog_tables(spark, folder):
    statements = fx.statements(spark, folder)
    named = source_relations(statements).select("db", "tbl").unionByName(statement_targets(statements).select("db", "tbl"))
    return named.where("db is not null").dropDuplicates(["db", "tbl"])


_SEEN = {
    1: [(_column_of(_S, "k"),), (_column_of(_H, "v"),), (_column_of(_T, "id"),), (_column_of(_T, "m"),)],
    2: [(_column_of(_S, c),) for c in ("id", "m", "n")] + [(_column_of(_T, c),) for c in ("id", "q")],
    3: [(_column_of(_S, "id"),), (_column_of(_T, "id"),), (_column_of(_T, "k2"),)],
    4: [(_column_of(_S, "cost"),), (_column_of(_S, "qty"),)],
}


def _columns(statements: DataFrame) -> DataFrame:
    statements = statements.select("stmt_id", "seq", "sql")
    return catalog.known_columns(_links(statements), catalog.declared_columns(statements))


@query("catalog_columns", f"SELECT name, min(stmt_id) AS first_seq FROM ({_rows(_SEEN, ('name',))}) GROUP BY name")
def catalog_columns(spark, folder):
    found = _columns(fx.statements(spark, folder)).where("scope is null")
    return found.select(full_name(F.col("db"), F.col("tbl"), F.col("col")).alias("name"), "first_seq")


_QUALIFIED = {
    1: [(_column_of(_S, "k"), "'a.k'"), (_column_of(_H, "v"), "'b.v'")],
    3: [(_column_of(_S, "id"), "'b.id'")],
    4: [(_column_of(_S, "cost"), "'w.cost'"), (_column_of(_S, "qty"), "'w.qty'")],
}


@query("resolve_qualified", _rows(_QUALIFIED, ("base", "seen")))
def resolve_qualified(spark, folder):
    found = with_full_names(_links(fx.statements(spark, folder)).where("rule = 'alias' AND dst IS NOT NULL"))
    return found.select("stmt_id", F.col("src").alias("base"), F.col("dst").alias("seen")).distinct()


@query("resolve_single_scope", _rows({2: [(_column_of(_S, c),) for c in ("id", "m", "n")]}, ("name",)))
def resolve_single_scope(spark, folder):
    found = with_full_names(_links(fx.statements(spark, folder)).where("rule = 'alias' AND dst IS NULL"))
    return found.select("stmt_id", F.col("src").alias("name")).distinct()


_SETTLED = """WITH known AS (SELECT o_custkey AS s, o_orderkey % 3 AS c, min(o_orderkey) AS first_seq FROM orders
                      WHERE o_orderkey % 2 = 0 GROUP BY ALL),
      asked AS (SELECT o_orderkey AS k, o_orderkey % 3 AS c, o_custkey + d AS s FROM orders, (VALUES (0), (1)) t(d) WHERE o_orderkey % 2 = 1),
      found AS (SELECT k, asked.c, count(known.s) AS n_owners, max(asked.s) FILTER (known.s IS NOT NULL) AS s
                FROM asked LEFT JOIN known ON known.s = asked.s AND known.c = asked.c AND known.first_seq <= asked.k GROUP BY k, asked.c)
      SELECT k AS stmt_id, concat('c', c) AS name, n_owners, CASE WHEN n_owners = 1 THEN concat('raw.s', s) END AS owner FROM found
      UNION ALL SELECT o_orderkey, 'd', 0, NULL FROM orders WHERE o_orderkey % 2 = 1"""


@query(
    "resolve_by_known_columns",
    _SETTLED,
)
def resolve_by_known_columns(spark, folder):
    statements = fx.scopes(spark, folder).select("stmt_id", "seq", "sql")
    links = materialize(_links(statements).distinct())
    settled = catalog.settle_loose(links, catalog.known_columns(links, catalog.declared_columns(statements)))
    return _settled(settled)


def _settled(loose: DataFrame) -> DataFrame:
    return loose.select(
        F.regexp_extract("src.scope", r"^#(\d+)", 1).cast("bigint").alias("stmt_id"),
        F.col("src.col").alias("name"),
        "n_owners",
        F.when(F.col("owner").isNotNull(), full_name(F.col("owner.db"), F.col("owner.tbl"))).alias("owner"),
    )


@query("merge_batches", _SETTLED)
def merge_batches(spark, folder):
    """A corpus read in two batches, the askers first: the columns that the second one brings settle their names again."""
    statements = fx.scopes(spark, folder).select("stmt_id", "seq", "sql")
    first = read_lineage(statements.where("stmt_id % 4 IN (1, 2)"))
    return _settled(read_lineage(statements.where("stmt_id % 4 NOT IN (1, 2)"), earlier=first).loose)


_DECLARED = _rows(
    {0: [("concat('d', c_custkey)", "'code'"), ("concat('d', c_custkey)", "'price'"), ("concat('d', c_custkey)", "concat('seg', c_nationkey)")]},
    ("tbl", "col"), 3, "c_custkey", "customer",
)


@query("declared_columns", f"SELECT stmt_id, 'db' AS db, tbl, col FROM ({_DECLARED})")
def declared_columns(spark, folder):
    return catalog.declared_columns(fx.ddl(spark, folder)).select("stmt_id", "db", "tbl", "col")


@query(
    "copy_schema_like",
    f"""WITH made AS ({_DECLARED}),
      copied AS (SELECT l.c_custkey AS seq, concat('d', l.c_custkey) AS tbl, made.col FROM customer l
                 JOIN made ON made.tbl = concat('d', l.c_custkey - 1) WHERE l.c_custkey % 3 = 1),
      filled AS (SELECT c_custkey AS seq, concat('d', c_custkey - d) AS tbl, col FROM customer, (VALUES (1), (2)) t(d), (VALUES ('code'), ('price')) u(col)
                 WHERE c_custkey % 3 = 2)
      SELECT tbl, col, min(seq) AS first_seq FROM
        (SELECT stmt_id AS seq, tbl, col FROM made UNION ALL SELECT * FROM copied UNION ALL SELECT * FROM filled) GROUP BY tbl, col""",
)
def copy_schema_like(spark, folder):
    statements = fx.ddl(spark, folder)
    known = materialize(_columns(statements))
    found = catalog.copy_schema_like(known, catalog.like_edges(statements)).where("scope is null")
    return found.select("tbl", "col", "first_seq")


_SCOPED = {
    1: [("'table'", "'a'"), ("'table'", "'b'"), ("'column'", "'a.k'"), ("'column'", "'b.v'"), ("'column'", "'max()'"), ("'column'", "'m'"), ("'column'", "'id'")],
    2: [("'column'", "'q'")],
    3: [("'table'", "'b'"), ("'column'", "'b.id'"), ("'column'", "'replace()'"), ("'column'", "'ord-'"), ("'column'", "'k2'")],
    4: [("'table'", "'w'"), ("'table'", "'nofacts'"), ("'column'", "'w.cost'"), ("'column'", "'w.qty'")],
}


@query(
    "catalog_vertices",
    f"""WITH cols AS ({_rows(_SEEN, ('name',))}), own AS (
      SELECT DISTINCT 'column' AS kind, name FROM cols
      UNION SELECT 'table', regexp_replace(name, '\\.[^.]*$', '') FROM cols
      UNION SELECT 'database', split_part(name, '.', 1) FROM cols)
      SELECT kind, name AS full_name, count(*) AS n_vertices FROM
        (SELECT kind, name FROM own UNION ALL SELECT kind, name FROM ({_rows(_SCOPED, ('kind', 'name'))})) GROUP BY ALL""",
)
def catalog_vertices(spark, folder):
    links = _links(fx.statements(spark, folder))
    mentioned = links.select(F.explode(F.array("src", "dst")).alias("v"))
    found = catalog.catalog_vertices(mentioned)
    return found.groupBy("kind", "full_name").agg(F.count("*").alias("n_vertices"))


@query(
    "contains_edges",
    """SELECT concat('d:', lower(r_name)) AS src, concat('t:', lower(r_name), '.', lower(n_name)) AS dst, 'contains' AS relation
       FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT concat('t:', lower(r_name), '.', lower(n_name)), concat('c:', lower(r_name), '.', lower(n_name), '.', lower(c_name)), 'contains'
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def contains_edges(spark, folder):
    named = (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    v = F.struct(F.lit(None).cast("string").alias("scope"), F.lower("r_name").alias("db"), F.lower("n_name").alias("tbl"), F.lower("c_name").alias("col"))
    return catalog.contains_edges(catalog.catalog_vertices(named.select(v.alias("v"))))


@query(
    "full_names",
    f"""SELECT {_T} AS name FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)
        UNION ALL SELECT 'nofacts' FROM orders WHERE o_orderkey % 5 = 4
        UNION ALL SELECT {_S} FROM orders WHERE o_orderkey % 5 > 0
        UNION ALL SELECT {_H} FROM orders WHERE o_orderkey % 5 = 1
        UNION ALL SELECT DISTINCT name FROM ({_rows(_SEEN, ('name',))})
        UNION ALL SELECT DISTINCT split_part(name, '.', 1) FROM ({_rows(_SEEN, ('name',))})""",
)
def full_names(spark, folder):
    """Each mention of a table, and every column and database of the catalog once."""
    statements = fx.statements(spark, folder)
    named = source_relations(statements).select("db", "tbl").unionByName(statement_targets(statements).select("db", "tbl"))
    columns = materialize(_columns(statements).where("scope is null"))
    mentions = named.select(full_name(F.col("db"), F.col("tbl")).alias("name"))
    of_columns = columns.select(full_name(F.col("db"), F.col("tbl"), F.col("col")).alias("name"))
    return mentions.unionByName(of_columns).unionByName(columns.select(F.col("db").alias("name")).distinct())


def _bracketed(*rows: tuple[int, str, str]) -> str:
    return " UNION ALL ".join(f"SELECT o_orderkey AS stmt_id, {tbl} AS tbl, {name} AS answers_to FROM orders WHERE o_orderkey % 4 = {form}" for form, tbl, name in rows)


@query(
    "bracketed_relations",
    _bracketed(
        (0, _S, "'g'"), (0, "'raw.r'", "'g'"), (1, _S, "'p'"), (1, "'raw.r'", "'r'"), (2, _S, "'p'"), (2, "'raw.q'", "'q'"), (2, "'raw.r'", "'r'"),
        (3, "'raw.d'", "'d'"), (3, _S, "'h'"), (3, "''", "'h'"), (3, "'raw.q'", "'q'"), (3, "'raw.r'", "'h'"),
    ),
)
def bracketed_relations(spark, folder):
    """Relations inside brackets of FROM clauses, and the name each answers to: that of the outermost named bracket, else its own."""
    found = source_relations(fx.bracketed(spark, folder))
    return found.select("stmt_id", full_name(F.col("db"), F.col("tbl")).alias("tbl"), F.coalesce("group_alias", "alias", "tbl").alias("answers_to"))


@query(
    "bracketed_owners",
    _rows(
        {0: [(_column_of(_S, "net"), "'g.net'")], 1: [(_column_of(_S, "net"), "'p.net'")], 2: [(_column_of(_S, "net"), "'p.net'")], 3: [(_column_of(_S, "fee"), "'h.fee'")]},
        ("base", "seen"), 4,
    ),
)
def bracketed_owners(spark, folder):
    """Which base column stands behind a name that goes through brackets: the first relation of a named one."""
    found = with_full_names(_links(fx.bracketed(spark, folder)).where("rule = 'alias' AND dst IS NOT NULL"))
    return found.select("stmt_id", F.col("src").alias("base"), F.col("dst").alias("seen")).distinct()


_VALUE = {
    1: [("'a.k'", "'id'"), ("'b.v'", "'max()'"), ("'max()'", "'m'")],
    2: [(_column_of(_S, "id"), _column_of(_T, "id")), (_column_of(_S, "m"), "'q'"), (_column_of(_S, "n"), "'q'")],
    3: [("'b.id'", _column_of(_T, "id")), ("'b.id'", "'replace()'"), ("'ord-'", "'replace()'"), ("'replace()'", "'k2'")],
}
_ALIAS = {form: [(base, seen) for base, seen in rows] for form, rows in _QUALIFIED.items()}
_INTO_TARGET = {
    1: [("'id'", _column_of(_T, "id")), ("'m'", _column_of(_T, "m"))],
    2: [("'q'", _column_of(_T, "q")), (_column_of(_S, "id"), _column_of(_T, "id"))],
    3: [("'k2'", _column_of(_T, "k2")), ("'b.id'", _column_of(_T, "id"))],
}


def _calls(rows: dict[int, list[tuple[str, str]]], wanted: bool) -> dict[int, list[tuple[str, str]]]:
    return {f: [r for r in found if ("()" in r[0] + r[1]) == wanted] for f, found in rows.items()}


def _flows(links: DataFrame) -> DataFrame:
    return with_full_names(links.where("dst IS NOT NULL")).select("stmt_id", "rule", "src", "dst").distinct()


@query("lineage_projection", f"{_rows(_calls(_VALUE, False), ('src', 'dst'))} UNION ALL {_rows(_ALIAS, ('src', 'dst'))}")
def lineage_projection(spark, folder):
    flows = _flows(_links(fx.statements(spark, folder))).where("rule IN ('value', 'alias')")
    return flows.where("NOT endswith(src, '()') AND NOT endswith(dst, '()')").select("stmt_id", "src", "dst")


@query("lineage_function", _rows(_calls(_VALUE, True), ("src", "dst")))
def lineage_function(spark, folder):
    flows = _flows(_links(fx.statements(spark, folder)))
    return flows.where("endswith(src, '()') OR endswith(dst, '()')").select("stmt_id", "src", "dst")


_EVERY_FLOW = {f: _VALUE.get(f, []) + _ALIAS.get(f, []) + _INTO_TARGET.get(f, []) for f in range(1, 5)}


@query("lineage_aggregate", f"SELECT DISTINCT * FROM ({_rows(_EVERY_FLOW, ('src', 'dst'))})")
def lineage_aggregate(spark, folder):
    return _flows(_links(fx.statements(spark, folder))).select("stmt_id", "src", "dst").distinct()


@query(
    "lineage_derived_table",
    _rows(
        {0: [("'part'", "'u.part'"), ("'u.part'", "concat('a.f', o_orderkey, '.part')")],
         1: [("'n.lot'", "'x.lot'"), ("'n.bin'", "'x.bin'"), ("'x.lot'", "'greatest()'"), ("'x.bin'", "'greatest()'")]},
        ("src", "dst"), 2,
    ),
)
def lineage_derived_table(spark, folder):
    links = _links(fx.nested(spark, folder)).where("src.scope LIKE '%/d%' OR dst.scope LIKE '%/d%'")
    return _flows(links).select("stmt_id", "src", "dst")


@query(
    "lineage_union",
    _rows({0: [("concat('b.s', o_custkey, '.part')", "'part'"), ("'c.z.piece'", "'part'"), ("'part'", "'u.part'")]}, ("src", "dst"), 2),
)
def lineage_union(spark, folder):
    links = _links(fx.nested(spark, folder)).where("src.scope LIKE '%/u/%' OR dst.scope LIKE '%/u/%'")
    return _flows(links).select("stmt_id", "src", "dst")


@query(
    "lineage_passthrough",
    _rows({0: [("'part'", "'u.part'")], 1: [("'n.lot'", "'x.lot'"), ("'n.bin'", "'x.bin'")]}, ("src", "dst"), 2),
)
def lineage_passthrough(spark, folder):
    links = _links(fx.nested(spark, folder)).where("dst.scope LIKE '%/d%'")
    return _flows(links).select("stmt_id", "src", "dst")


@query("lineage_ctas", _rows({f: _INTO_TARGET[f] for f in (1, 2, 3)}, ("src", "dst")))
def lineage_ctas(spark, folder):
    links = _links(fx.statements(spark, folder)).where("dst.db = 'mart'")
    return _flows(links).select("stmt_id", "src", "dst")


@query(
    "lineage_insert",
    _rows({2: [(f"'s.{c}'", f"concat('db.d', c_custkey - 1, '.{c}')") for c in ("code", "price")]}, ("src", "dst"), 3, "c_custkey", "customer"),
)
def lineage_insert(spark, folder):
    links = _links(fx.ddl(spark, folder)).where("dst.db = 'db'")
    return _flows(links).select("stmt_id", "src", "dst")


@query(
    "lineage_insert_by_position",
    _rows(
        {2: [("'s.amount'", "concat('db.g', c_custkey - 1, '.code')"), ("'top'", "concat('db.g', c_custkey - 1, '.price')"), ("'s.extra'", "concat('db.g', c_custkey - 1, '.extra')")]},
        ("src", "dst"), 3, "c_custkey", "customer",
    ),
)
def lineage_insert_by_position(spark, folder):
    """INSERT fills the columns at the items' places where the layout is known (copied by LIKE here); an item too many goes by its name."""
    statements = fx.placed(spark, folder).select("stmt_id", "seq", "sql")
    links = catalog.place_columns(token_links(statements, by_place=True), catalog.table_schemas(statements))
    return _flows(links.where("dst.db = 'db'")).select("stmt_id", "src", "dst")


@query(
    "find_stars",
    """SELECT DISTINCT concat('lake.t', k) AS tbl FROM (
       SELECT c_custkey AS k FROM customer WHERE c_custkey > 0 UNION ALL SELECT CAST(floor(c_custkey / 2) AS BIGINT) FROM customer WHERE c_custkey > 0)""",
)
def find_stars(spark, folder):
    found = stars.find_stars(_columns(fx.star_statements(spark, folder)))
    return found.select(full_name(F.col("db"), F.col("tbl")).alias("tbl"))


@query(
    "expand_stars",
    f"""WITH RECURSIVE {fx.STARS_SQL}, owned AS (SELECT tbl, col FROM cols UNION SELECT dst_tbl, col FROM owned JOIN stars ON src_tbl = tbl)
        SELECT owned.tbl, owned.col, cols.tbl IS NULL AS inherited FROM owned LEFT JOIN cols ON cols.tbl = owned.tbl AND cols.col = owned.col""",
)
def expand_stars(spark, folder):
    return stars.expand_stars(fx.star_edges(spark, folder), fx.star_columns(spark, folder))


@query(
    "unresolvable_stars",
    """SELECT concat('s', CAST(floor(s_suppkey / 10) * 10 AS BIGINT) + (s_suppkey + 1) % 10) AS tbl FROM supplier
       UNION ALL SELECT concat('below', s_suppkey) FROM supplier""",
)
def unresolvable_stars(spark, folder):
    trees = fx.star_edges(spark, folder)
    return stars.unresolvable_stars(trees.unionByName(fx.star_rings(spark, folder)))


def _numbered(spark, folder) -> DataFrame:
    statements = prepare.prepare_scripts(fx.lines(spark, folder)).join(fx.manifest(spark, folder), "file")
    return prepare.number_statements(statements)


_FILE = "CASE WHEN o_orderkey % 3 = 0 OR o_custkey > 0 THEN TRUE ELSE FALSE END"


@query(
    "table_lineage",
    f"""SELECT DISTINCT concat('raw.s', o_custkey) AS src_table, {_T} AS dst_table FROM orders WHERE {_FILE}
        UNION SELECT {_H}, {_T} FROM orders WHERE {_FILE} AND o_orderkey > 0""",
)
def table_lineage(spark, folder):
    """Which table feeds which, over the whole listed script corpus."""
    read = target_relations(_numbered(spark, folder)).where("derived_block IS NULL AND target_tbl IS NOT NULL")
    pairs = read.select(
        full_name(F.col("db"), F.col("tbl")).alias("src_table"), full_name(F.col("target_db"), F.col("target_tbl")).alias("dst_table")
    )
    return distinct_pairs(pairs)


@query(
    "lineage_rejects",
    """SELECT o_orderkey AS stmt_id, CASE o_orderkey % 6 WHEN 3 THEN 'limit' ELSE 'statement' END AS reason
       FROM orders WHERE o_orderkey % 6 IN (3, 5)""",
)
def lineage_rejects(spark, folder):
    statements = fx.expressions(spark, folder).withColumn("seq", F.col("stmt_id"))
    return statement_rejects(statements).select("stmt_id", "reason")


@query(
    "unresolved_star_report",
    """SELECT concat('s', CAST(floor(s_suppkey / 10) * 10 AS BIGINT) + (s_suppkey + 1) % 10) AS dst, 'cycle' AS reason FROM supplier""",
)
def unresolved_star_report(spark, folder):
    """Stars read from statements in which each table takes all columns of the next in its ring."""
    return unresolved_stars(_links(fx.ring_statements(spark, folder))).select(F.regexp_replace("dst", r"^lake\.(.*)\.\*$", "$1").alias("dst"), "reason").where("reason = 'cycle'")


@query(
    "merge_scripts",
    f"""SELECT DISTINCT name FROM (SELECT concat('raw.s', o_custkey, '.k') AS name FROM orders WHERE {_FILE}
        UNION ALL SELECT concat({_H}, '.v', o_orderkey % 7) FROM orders WHERE {_FILE}
        UNION ALL SELECT concat({_T}, c) FROM orders, (VALUES ('.id'), ('.m'), ('.tag')) t(c) WHERE {_FILE})""",
)
def merge_scripts(spark, folder):
    # Stored, since links and declared columns both read it.
    statements = materialize(_numbered(spark, folder).select("stmt_id", "seq", "sql"))
    found = _columns(statements).where("scope is null")
    return found.select(full_name(F.col("db"), F.col("tbl"), F.col("col")).alias("name"))


@query(
    "merge_star_batches",
    f"""WITH RECURSIVE {fx.TREE_SQL}, owned AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT src FROM tree JOIN owned ON dst = node)
        SELECT concat('lake.t', node, '.c0') AS dst FROM owned WHERE node > 0""",
)
def merge_star_batches(spark, folder):
    """Tables that take all columns of another, read in two batches; the one column there is comes with the second."""
    statements = fx.star_statements(spark, folder)
    first = read_lineage(statements.where("stmt_id % 3 > 0"))
    result = lineage_result(read_lineage(statements.where("stmt_id % 3 = 0"), earlier=first))
    tables = result.vertices.where("kind = 'column' AND db = 'lake' AND name = 'c0'").select(F.col("id").alias("dst"), "full_name")
    return result.edges.where("relation = 'used for'").join(tables, "dst").select(F.col("full_name").alias("dst")).distinct()
