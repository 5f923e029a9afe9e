"""Queries over script text: reading, preparing, and the facts of each statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.functions.text import BLANKS, normalize_identifier
from headwater.operators import blocks, facts, prepare
from headwater.plans import fixtures as fx
from headwater.plans.registry import query, table
from headwater.sources import scripts

_BLANKS_SQL = "concat(" + ", ".join(f"chr({ord(c)})" for c in BLANKS if ord(c) > 0) + ")"
_COMMENT_SQL = r"""regexp_replace({0}, '^((?:[^''"\-]|-[^\-]|''[^'']*''|"[^"]*")*)--.*$', '\1')"""
_HASH_SQL = "CASE WHEN starts_with({0}, '#') THEN '' ELSE {0} END"
_VARIABLES_SQL = (
    r"regexp_replace(regexp_replace({0}, '\$\{{(\w+?):(\S+?)\^*\}}', '\1-\2', 'g'), '\$\{{(\S+?)\^*\}}', '\1', 'g')"
)


def _split_sql(line: str) -> str:
    """Statements of CTE ``lines`` with each line put through ``line``."""
    return f"""st AS (SELECT file, i - 1 AS seq, trim(parts[i], {_BLANKS_SQL}) AS sql FROM
      (SELECT file, string_split(string_agg({line}, ' ' ORDER BY line_no), ';') AS parts FROM lines GROUP BY file),
      LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE trim(parts[i], {_BLANKS_SQL}) <> '')"""


_CLEAN_SQL = f"replace({_COMMENT_SQL.format('(' + _HASH_SQL.format('line') + ')')}, 'STORED AS PARQUET', '')"
PREPARED_SQL = f"{fx.LINES_SQL}, {_split_sql(_CLEAN_SQL)}, prepared AS (SELECT file, seq, {_VARIABLES_SQL.format('sql')} AS sql FROM st)"


@query(
    "scan_script_lines",
    r"""SELECT file, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS line FROM
      (SELECT CAST(doc_id AS STRING) AS file,
              regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n') AS parts
       FROM documents WHERE text <> ''), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)""",
)
def scan_script_lines(spark, folder):
    docs = table(spark, folder, "documents")
    return scripts.split_script_text(docs.select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("body")))


@query(
    "manifest_scripts",
    f"WITH {fx.LINES_SQL}, {fx.MANIFEST_SQL} SELECT file, ord, line_no, line FROM lines JOIN manifest USING (file)",
)
def manifest_scripts(spark, folder):
    return scripts.manifest_scripts(fx.lines(spark, folder), fx.manifest(spark, folder))


@query(
    "missing_scripts",
    f"WITH {fx.LINES_SQL}, {fx.MANIFEST_SQL} SELECT file, ord FROM manifest WHERE file NOT IN (SELECT file FROM lines)",
)
def missing_scripts(spark, folder):
    return scripts.missing_scripts(fx.lines(spark, folder), fx.manifest(spark, folder))


@query(
    "run_summary",
    f"WITH {PREPARED_SQL} SELECT file, count(*) AS n_statements FROM prepared GROUP BY ROLLUP (file)",
)
def run_summary(spark, folder):
    return scripts.run_summary(prepare.prepare_scripts(fx.lines(spark, folder)))


@query("drop_hash_lines", f"WITH {fx.LINES_SQL} SELECT file, line_no, {_HASH_SQL.format('line')} AS line FROM lines")
def drop_hash_lines(spark, folder):
    return prepare.drop_hash_lines(fx.lines(spark, folder))


@query("strip_dash_comments", f"WITH {fx.LINES_SQL} SELECT file, line_no, {_COMMENT_SQL.format('line')} AS line FROM lines")
def strip_dash_comments(spark, folder):
    return prepare.strip_dash_comments(fx.lines(spark, folder))


@query("erase_keywords", f"WITH {fx.LINES_SQL} SELECT file, line_no, replace(line, 'STORED AS PARQUET', '') AS line FROM lines")
def erase_keywords(spark, folder):
    return prepare.erase_keywords(fx.lines(spark, folder))


@query("split_statements", f"WITH {fx.LINES_SQL}, {_split_sql('line')} SELECT file, seq, sql FROM st")
def split_statements(spark, folder):
    return prepare.split_statements(fx.lines(spark, folder))


@query("substitute_variables", f"WITH {fx.LINES_SQL} SELECT file, line_no, {_VARIABLES_SQL.format('line')} AS sql FROM lines")
def substitute_variables(spark, folder):
    return prepare.substitute_variables(fx.lines(spark, folder).withColumnRenamed("line", "sql"))


@query(
    "normalize_identifiers",
    "SELECT o_orderkey AS stmt_id, lower(concat('MART.T', CAST(o_orderkey AS STRING), '.', o_orderpriority)) AS name FROM orders",
)
def normalize_identifiers(spark, folder):
    raw = F.concat(F.lit("`MART`.T"), F.col("o_orderkey").cast("string"), F.lit(".`"), "o_orderpriority", F.lit("`"))
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("stmt_id"), normalize_identifier(raw).alias("name"))


@query("prepare_scripts", f"WITH {PREPARED_SQL} SELECT file, seq, sql FROM prepared")
def prepare_scripts(spark, folder):
    return prepare.prepare_scripts(fx.lines(spark, folder))


_TOKEN_SQL = r"""'(?:[^']*)'|"[^"]*"|(?:[\p{L}\p{N}_$]+)(?:\.(?:[\p{L}\p{N}_$]+|\*))*|<=>|<>|!=|<=|>=|==|\|\||&&|\S"""
_TOKENS_SQL = f"""tokens AS (SELECT stmt_id, i - 1 AS pos, CASE WHEN toks[i] LIKE '''%' THEN toks[i] ELSE lower(toks[i]) END AS tok FROM
  (SELECT stmt_id, regexp_extract_all(sql, '{_TOKEN_SQL.replace("'", "''")}') AS toks FROM st),
  LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i))"""


@query(
    "tokenize_statements",
    f"""WITH {fx.STATEMENTS_SQL}, {_TOKENS_SQL} SELECT stmt_id, CAST(pos AS INT) AS pos, tok,
        CASE WHEN tok LIKE '''%' THEN 'string' WHEN regexp_full_match(tok, '[0-9]+') THEN 'number'
             WHEN regexp_matches(tok, '^[a-z0-9_]') THEN 'word' ELSE 'symbol' END AS kind FROM tokens""",
)
def tokenize_statements(spark, folder):
    return blocks.tokenize_statements(fx.statements(spark, folder).select("stmt_id", "sql"))


@query(
    "nest_blocks",
    f"""WITH {fx.NESTED_SQL}, {_TOKENS_SQL},
      run AS (SELECT *, lead(tok) OVER (PARTITION BY stmt_id ORDER BY pos) AS nxt,
              sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY stmt_id ORDER BY pos)
                + CASE tok WHEN ')' THEN 1 ELSE 0 END AS level FROM tokens),
      pairs AS (SELECT stmt_id, tok, nxt, pos AS o, lead(pos) OVER (PARTITION BY stmt_id, level ORDER BY pos) AS c
              FROM run WHERE tok IN ('(', ')'))
      SELECT r.stmt_id, CAST(r.pos AS INT) AS pos, r.tok, CAST(r.level AS INT) AS level, CAST(coalesce(max(p.o), -1) AS INT) AS block_id
      FROM run r LEFT JOIN pairs p ON p.stmt_id = r.stmt_id AND p.tok = '(' AND p.nxt = 'select' AND p.o <= r.pos AND r.pos < p.c
      GROUP BY r.stmt_id, r.pos, r.tok, r.level""",
)
def nest_blocks(spark, folder):
    return blocks.nest_blocks(fx.nested(spark, folder)).select("stmt_id", "pos", "tok", "level", "block_id")


@query(
    "classify_statements",
    """SELECT o_orderkey AS stmt_id, CASE o_orderkey % 5 WHEN 0 THEN 'drop' WHEN 1 THEN 'ctas' WHEN 2 THEN 'ctas'
       WHEN 3 THEN 'insert' ELSE 'select' END AS kind FROM orders""",
)
def classify_statements(spark, folder):
    return facts.classify_statements(fx.statements(spark, folder)).select("stmt_id", "kind")


@query(
    "statement_targets",
    """SELECT o_orderkey AS stmt_id, CASE o_orderkey % 5 WHEN 3 THEN 'insert' ELSE 'ctas' END AS kind, 'mart' AS db,
       concat('t', o_orderkey) AS tbl, CAST(NULL AS STRING) AS source_db, CAST(NULL AS STRING) AS source_tbl
       FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)""",
)
def statement_targets(spark, folder):
    return facts.statement_targets(fx.statements(spark, folder))


_RELATIONS_SQL = """rel AS (
  SELECT o_orderkey AS stmt_id, 'raw' AS db, concat('s', o_custkey) AS tbl, CASE o_orderkey % 5 WHEN 1 THEN 'a' WHEN 3 THEN 'b' WHEN 4 THEN 'w' END AS alias
  FROM orders WHERE o_orderkey % 5 > 0
  UNION ALL SELECT o_orderkey, 'mart', concat('t', CAST(floor(o_orderkey / 2) AS BIGINT)), 'b' FROM orders WHERE o_orderkey % 5 = 1
  UNION ALL SELECT o_orderkey, NULL, 'nofacts', NULL FROM orders WHERE o_orderkey % 5 = 4)"""


@query("source_relations", f"WITH {_RELATIONS_SQL} SELECT stmt_id, db, tbl, alias FROM rel")
def source_relations(spark, folder):
    return facts.source_relations(fx.statements(spark, folder)).select("stmt_id", "db", "tbl", "alias")


@query(
    "scope_aliases",
    """SELECT o_orderkey AS stmt_id, 'outer' AS place, CASE o_orderkey % 2 WHEN 0 THEN 'u' ELSE 'x' END AS scope_name, 'derived' AS scope_kind, '' AS behind FROM orders
       UNION ALL SELECT o_orderkey, 'inner', CASE o_orderkey % 2 WHEN 0 THEN concat('s', o_custkey) ELSE 'n' END,
         CASE o_orderkey % 2 WHEN 0 THEN 'table' ELSE 'alias' END, concat('b.s', o_custkey) FROM orders
       UNION ALL SELECT o_orderkey, 'inner', 'z', 'table', 'c.z' FROM orders WHERE o_orderkey % 2 = 0""",
)
def scope_aliases(spark, folder):
    place = "CASE WHEN block_id = -1 THEN 'outer' ELSE 'inner' END AS place"
    return facts.scope_names(fx.nested(spark, folder)).selectExpr("stmt_id", place, "scope_name", "scope_kind", "behind")


_ITEMS_SQL = """items AS (
  SELECT o_orderkey AS stmt_id, i AS item_no,
    CASE o_orderkey % 5 WHEN 1 THEN ['id', 'm'] WHEN 2 THEN ['id', 'q'] WHEN 3 THEN ['id', 'k2'] ELSE ['cost', 'qty'] END[i + 1] AS out_name
  FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 5 > 0)"""


@query("select_items", f"WITH {_ITEMS_SQL} SELECT stmt_id, item_no, out_name, FALSE AS is_star, CAST(NULL AS STRING) AS star_qualifier FROM items")
def select_items(spark, folder):
    return facts.select_items(fx.statements(spark, folder)).select("stmt_id", "item_no", "out_name", "is_star", "star_qualifier")


@query(
    "name_outputs",
    """SELECT o_orderkey AS stmt_id, i AS item_no,
         CASE o_orderkey % 6 WHEN 0 THEN ['hit', 'y'] WHEN 1 THEN ['rn'] WHEN 2 THEN ['z', 'nf', 'h'] ELSE ['c', 'unresolvedalias'] END[i + 1] AS out_name
       FROM orders, (VALUES (0), (1), (2)) t(i)
       WHERE o_orderkey % 6 IN (0, 1, 2, 4) AND i < CASE o_orderkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END""",
)
def name_outputs(spark, folder):
    return facts.select_items(fx.expressions(spark, folder)).select("stmt_id", "item_no", "out_name")


def _by_form(cases: dict[int, list[tuple]], modulo: int, columns: str) -> str:
    """Rows that each statement form is written to have, as SQL over ``orders``."""
    rows = ", ".join("(" + ", ".join([str(form), *map(str, row)]) + ")" for form, found in cases.items() for row in found)
    return f"SELECT o_orderkey AS stmt_id, {columns} FROM orders JOIN (VALUES {rows}) AS t(form, {columns}) ON o_orderkey % {modulo} = form"


def _q(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else f"'{text}'"


def _refs(*found: tuple[int, str | None, str]) -> list[tuple]:
    return [(item, _q(qualifier), _q(name)) for item, qualifier, name in found]


@query(
    "column_references",
    _by_form(
        {1: _refs((0, "a", "k"), (1, "b", "v")), 2: _refs((0, None, "id"), (1, None, "m"), (1, None, "n")),
         3: _refs((0, "b", "id"), (1, "b", "id")), 4: _refs((0, "w", "cost"), (1, "w", "qty"))},
        5, "item_no, qualifier, name",
    ),
)
def column_references(spark, folder):
    return facts.item_references(fx.statements(spark, folder)).where("role = 'ref'").select("stmt_id", "item_no", "qualifier", "name")


@query("function_references", _by_form({1: [(1, "'max()'")], 3: [(1, "'replace()'")]}, 5, "item_no, name"))
def function_references(spark, folder):
    return facts.item_references(fx.statements(spark, folder)).where("role = 'call'").select("stmt_id", "item_no", "name")


@query(
    "literal_references",
    """SELECT o_orderkey AS stmt_id, 0 AS item_no, lower(l) AS name FROM orders, (VALUES ('O'), ('N')) t(l) WHERE o_orderkey % 6 = 4
       UNION ALL SELECT o_orderkey, 1, '1' FROM orders WHERE o_orderkey % 6 = 4
       UNION ALL SELECT o_orderkey, 0, CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 6 = 2""",
)
def literal_references(spark, folder):
    return facts.item_references(fx.expressions(spark, folder)).where("role = 'literal'").select("stmt_id", "item_no", "name")


@query(
    "case_roles",
    _by_form({2: [(_q("m"), _q("value")), (_q("n"), _q("value")), (_q("p"), _q("else"))]}, 5, "name, case_part"),
)
def case_roles(spark, folder):
    found = facts.item_references(fx.statements(spark, folder), with_else=True)
    return found.where("out_name = 'q'").select("stmt_id", "name", "case_part")


@query(
    "value_only_filter",
    _by_form(
        {1: [(_q("a"), _q("k")), (_q("b"), _q("v"))], 2: [(_q(None), _q(n)) for n in ("id", "m", "n")],
         3: [(_q("b"), _q("id"))] * 2, 4: [(_q("w"), _q("cost")), (_q("w"), _q("qty"))]},
        5, "qualifier, name",
    ),
)
def value_only_filter(spark, folder):
    found = facts.item_references(fx.statements(spark, folder))
    return found.where("role = 'ref'").select("stmt_id", "qualifier", "name")


# What each form of the expressions feeds into its outputs; keys of literals are the statement's own.
_INPUTS = {
    0: [("hit", "x"), ("y", "y")],
    1: [("rn", "row_number()")],
    2: [("z", "x"), ("z", "y"), ("nf", "f"), ("h", "g")],
    4: [("c", "w"), ("c", "x"), ("c", "y"), ("c", "o"), ("c", "n"), ("unresolvedalias", "x"), ("unresolvedalias", "1")],
}
_INPUTS_SQL = _by_form({f: [(_q(o), _q(n)) for o, n in rows] for f, rows in _INPUTS.items()}, 6, "out_name, name") + """
    UNION ALL SELECT o_orderkey, 'z', CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 6 = 2"""


def _inputs(spark, folder):
    return facts.item_references(fx.expressions(spark, folder)).select("stmt_id", "out_name", F.lower("name").alias("name"))


@query("in_value_only", _INPUTS_SQL)
def in_value_only(spark, folder):
    """Whole corpus: of ``x IN (…)`` only x is among the inputs."""
    return _inputs(spark, folder)


@query("window_function_only", f"SELECT * FROM ({_INPUTS_SQL}) WHERE out_name <> 'hit'")
def window_function_only(spark, folder):
    """Whole corpus: of ``f() OVER (…)`` only f is among the inputs."""
    return _inputs(spark, folder).where("out_name <> 'hit'")


@query(
    "operator_inputs",
    _by_form(
        {2: [(_q("z"), _q("x")), (_q("z"), _q("y")), (_q("nf"), _q("f")), (_q("h"), _q("g"))],
         4: [(_q("c"), _q("w")), (_q("c"), _q("x")), (_q("c"), _q("y")), (_q("unresolvedalias"), _q("x"))]},
        6, "out_name, name",
    ),
)
def operator_inputs(spark, folder):
    found = facts.item_references(fx.expressions(spark, folder)).where("role = 'ref' AND out_name NOT IN ('hit', 'y', 'rn')")
    return found.select("stmt_id", "out_name", "name")


@query(
    "reject_report",
    """SELECT CASE o_orderkey % 6 WHEN 3 THEN 'limit' ELSE 'statement' END AS reason, count(*) AS n_statements
       FROM orders WHERE o_orderkey % 6 IN (3, 5) GROUP BY 1""",
)
def reject_report(spark, folder):
    return facts.reject_report(fx.expressions(spark, folder))
