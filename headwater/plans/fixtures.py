"""Script corpora and graphs derived from the given tables, once for Spark and once as SQL.

The expressions below read the same in both dialects. ``chr(36)`` is the dollar sign, which
Spark would take for a variable of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from headwater.plans.registry import table
from headwater.session import shuffle_width


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


KEY, CUST = _s("o_orderkey"), _s("o_custkey")
HALF = _s("CAST(floor(o_orderkey / 2) AS BIGINT)")
VAR = "concat(chr(36), '{MART}')"

# One script gathers a third of all orders; the others belong to one customer each.
SCRIPT = f"CASE WHEN o_orderkey % 3 = 0 THEN 'job_main.sql' ELSE concat('job_', {CUST}, '.sql') END"

LINES = (
    f"concat('#@ order ', {KEY}, ' ; ignored')",
    f"concat('DROP TABLE IF EXISTS ', {VAR}, '.t', {KEY}, '; -- reset ; it')",
    f"concat('CREATE TABLE ', {VAR}, '.t', {KEY}, ' STORED AS PARQUET AS -- build')",
    f"concat('SELECT a.k AS id, MAX(b.v', {_s('o_orderkey % 7')}, ') AS m, \"x--', o_orderstatus, '\" AS tag')",
    f"concat('FROM ', chr(36), '{{RAW^^}}.s', {CUST}, ' a')",
    f"concat('INNER JOIN ', {VAR}, '.t', {HALF}, ' b ON (a.k = b.id) GROUP BY a.k;')",
    "concat('SET stage=', chr(36), '{conf:', lower(substring(o_orderpriority, 3)), '};')",
)

STATEMENT = f"""CASE o_orderkey % 5
  WHEN 0 THEN concat('DROP TABLE IF EXISTS mart.t', {KEY})
  WHEN 1 THEN concat('CREATE TABLE mart.t', {KEY}, ' AS SELECT a.k AS id, MAX(b.v) AS m FROM raw.s', {CUST}, ' a INNER JOIN mart.t', {HALF}, ' b ON (a.k = b.id) WHERE b.w > 3 GROUP BY a.k')
  WHEN 2 THEN concat('CREATE TABLE mart.t', {KEY}, ' AS SELECT id, CASE WHEN m IS NULL THEN n ELSE p END AS q FROM raw.s', {CUST})
  WHEN 3 THEN concat('INSERT INTO mart.t', {KEY}, ' SELECT b.id, replace(b.id, ''ord-'') AS k2 FROM raw.s', {CUST}, ' b')
  ELSE concat('SELECT W.Cost, w.qty FROM raw.s', {CUST}, ' W, nofacts') END"""

NESTED = f"""CASE WHEN o_orderkey % 2 = 0
  THEN concat('CREATE TABLE a.f', {KEY}, ' AS SELECT part FROM (SELECT part FROM b.s', {CUST}, ' UNION SELECT piece FROM c.z) u')
  ELSE concat('CREATE TABLE a.f', {KEY}, ' AS SELECT greatest(x.lot, x.bin) AS k FROM (SELECT DISTINCT n.lot, n.bin FROM b.s', {CUST}, ' n WHERE n.bay IN (1,2) ORDER BY n.aisle) x') END"""

EXPRESSIONS = f"""CASE o_orderkey % 6
  WHEN 0 THEN concat('SELECT a.x IN (1, 2, ', {KEY}, ') AS hit, r.y FROM raw.s', {CUST}, ' a, raw.r')
  WHEN 1 THEN concat('SELECT row_number() OVER (PARTITION BY a.p ORDER BY a.q) AS rn FROM raw.s', {CUST}, ' a')
  WHEN 2 THEN concat('SELECT CAST(a.x AS DECIMAL(15,2)) + a.y * ', {KEY}, ' AS z, NOT a.f AS nf, a.g IS NOT NULL AS h FROM raw.s', {CUST}, ' a')
  WHEN 3 THEN concat('SELECT a.x FROM raw.s', {CUST}, ' a LIMIT ', {KEY})
  WHEN 4 THEN concat('SELECT CASE a.w WHEN ''O'' THEN a.x WHEN ''N'' THEN a.y ELSE a.z END AS c, a.x + 1 FROM raw.s', {CUST}, ' a')
  ELSE concat('MERGE INTO mart.t', {KEY}, ' USING raw.s', {CUST}) END"""

BRACKETED = f"""CASE o_orderkey % 4
  WHEN 0 THEN concat('INSERT INTO mart.t', {KEY}, ' SELECT g.net FROM (raw.s', {CUST}, ' JOIN raw.r ON s', {CUST}, '.k = r.k) g')
  WHEN 1 THEN concat('SELECT p.net, r.fee FROM (raw.s', {CUST}, ' p LEFT JOIN raw.r ON p.k = r.k)')
  WHEN 2 THEN concat('SELECT p.net, q.fee, r.tax FROM raw.s', {CUST}, ' p JOIN (raw.q JOIN raw.r ON q.k = r.k) ON p.k = q.k')
  ELSE concat('SELECT d.net, h.fee FROM raw.d, ((raw.s', {CUST}, ' JOIN (SELECT fee FROM raw.q) x) JOIN raw.r) h') END"""

SCOPES = f"""CASE WHEN o_orderkey % 2 = 0
  THEN concat('SELECT x.c', {_s('o_orderkey % 3')}, ' FROM raw.s', {CUST}, ' x')
  ELSE concat('SELECT c', {_s('o_orderkey % 3')}, ', d FROM raw.s', {CUST}, ', raw.s', {_s('o_custkey + 1')}) END"""

DDL = f"""CASE c_custkey % 3
  WHEN 0 THEN concat('CREATE EXTERNAL TABLE db.d', {_s('c_custkey')}, ' (CODE STRING, PRICE DECIMAL(12,3), SEG', {_s('c_nationkey')}, ' INT) LOCATION ''/data/raw''')
  WHEN 1 THEN concat('CREATE TABLE db.d', {_s('c_custkey')}, ' LIKE db.d', {_s('c_custkey - 1')})
  ELSE concat('INSERT INTO db.d', {_s('c_custkey - 1')}, ' SELECT s.code, s.price FROM db.d', {_s('c_custkey - 2')}, ' s') END"""

PLACES = f"""CASE c_custkey % 3
  WHEN 0 THEN concat('CREATE TABLE db.g', {_s('c_custkey')}, ' (CODE STRING, PRICE DECIMAL(12,3))')
  WHEN 1 THEN concat('CREATE TABLE db.g', {_s('c_custkey')}, ' LIKE db.g', {_s('c_custkey - 1')})
  ELSE concat('INSERT INTO db.g', {_s('c_custkey - 1')}, ' SELECT s.amount, max(s.label) AS top, s.extra FROM raw.s', {_s('c_nationkey')}, ' s') END"""

STARS = f"""CASE WHEN c_custkey = 0 THEN 'SELECT z.c0 FROM lake.t0 z'
  ELSE concat('CREATE TABLE lake.t', {_s('c_custkey')}, ' AS SELECT * FROM lake.t', {_s('CAST(floor(c_custkey / 2) AS BIGINT)')}) END"""

_GRAPH_VERTICES = (
    ("region", "concat('r', {k}) AS id", "r_regionkey", "lower(r_name) AS name", "database"),
    ("nation", "concat('n', {k}) AS id", "n_nationkey", "lower(n_name) AS name", "table"),
    ("customer", "concat('c', {k}) AS id", "c_custkey", "lower(c_name) AS name", "column"),
)
_GRAPH_EDGES = (
    ("nation", f"concat('r', {_s('n_regionkey')}) AS src", f"concat('n', {_s('n_nationkey')}) AS dst", "contains"),
    ("customer", f"concat('n', {_s('c_nationkey')}) AS src", f"concat('c', {_s('c_custkey')}) AS dst", "contains"),
    ("orders", f"concat('c', {_s('o_custkey')}) AS src", f"concat('c', {_s('o_custkey % 10')}) AS dst", "used for"),
)


def _source(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The columns a corpus is made from, in at least as many parts as there are tasks.

    Text takes many times the room of its keys, so a table small enough to be read as one
    part is spread while it is still narrow. Larger ones come in enough parts already.
    """
    rows = table(spark, folder, name).select(*columns)
    width = shuffle_width(spark)
    return rows.repartition(width) if rows.rdd.getNumPartitions() < width else rows


def lines(spark: SparkSession, folder: str) -> DataFrame:
    exploded = _source(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").selectExpr(
        f"{SCRIPT} AS file", "o_orderkey", f"posexplode(array({', '.join(LINES)})) AS (n, line)"
    )
    return exploded.selectExpr("file", "o_orderkey * 10 + n AS line_no", "line")


LINES_SQL = f"""lines AS (SELECT file, o_orderkey * 10 + n AS line_no, texts[n + 1] AS line FROM
  (SELECT {SCRIPT} AS file, o_orderkey, [{', '.join(LINES)}] AS texts FROM orders), range(0, {len(LINES)}) AS t(n))"""

_MANIFEST_CUSTOMER = f"CASE WHEN c_custkey = 0 THEN 'job_main.sql' ELSE concat('job_', {_s('c_custkey')}, '.sql') END AS file"
_MANIFEST_SUPPLIER = f"concat('load_', {_s('s_suppkey')}, '.sql') AS file"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer's script but the first one's, then one per supplier, which nobody wrote."""
    jobs = table(spark, folder, "customer").selectExpr(_MANIFEST_CUSTOMER, "c_custkey AS ord")
    loads = table(spark, folder, "supplier").selectExpr(_MANIFEST_SUPPLIER, "1000000000 + s_suppkey AS ord")
    return jobs.unionByName(loads)


MANIFEST_SQL = f"""manifest AS (SELECT {_MANIFEST_CUSTOMER}, c_custkey AS ord FROM customer
  UNION ALL SELECT {_MANIFEST_SUPPLIER}, 1000000000 + s_suppkey AS ord FROM supplier)"""


def _of_orders(text: str):
    def make(spark: SparkSession, folder: str) -> DataFrame:
        return _source(spark, folder, "orders", "o_orderkey", "o_custkey").selectExpr("o_orderkey AS stmt_id", f"{SCRIPT} AS file", "o_orderkey AS seq", f"{text} AS sql")

    return make, f"st AS (SELECT o_orderkey AS stmt_id, {SCRIPT} AS file, o_orderkey AS seq, {text} AS sql FROM orders)"


def _of_customers(text: str):
    def make(spark: SparkSession, folder: str) -> DataFrame:
        return _source(spark, folder, "customer", "c_custkey", "c_nationkey").selectExpr("c_custkey AS stmt_id", "c_custkey AS seq", f"{text} AS sql")

    return make, f"st AS (SELECT c_custkey AS stmt_id, c_custkey AS seq, {text} AS sql FROM customer)"


statements, STATEMENTS_SQL = _of_orders(STATEMENT)
nested, NESTED_SQL = _of_orders(NESTED)
expressions, EXPRESSIONS_SQL = _of_orders(EXPRESSIONS)
scopes, SCOPES_SQL = _of_orders(SCOPES)
bracketed, BRACKETED_SQL = _of_orders(BRACKETED)
ddl, DDL_SQL = _of_customers(DDL)
placed, PLACED_SQL = _of_customers(PLACES)
star_statements, STAR_STATEMENTS_SQL = _of_customers(STARS)


def tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").where("c_custkey > 0").selectExpr("c_custkey AS src", "CAST(floor(c_custkey / 2) AS BIGINT) AS dst")


TREE_SQL = "tree AS (SELECT c_custkey AS src, CAST(floor(c_custkey / 2) AS BIGINT) AS dst FROM customer WHERE c_custkey > 0)"


def cycle_edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS src", "CAST(floor(c_custkey / 10) * 10 AS BIGINT) + (c_custkey + 1) % 10 AS dst"
    )


CYCLE_SQL = """rings AS (SELECT c_custkey AS src,
  CAST(floor(c_custkey / 10) * 10 AS BIGINT) + (c_custkey + 1) % 10 AS dst FROM customer)"""


def star_edges(spark: SparkSession, folder: str) -> DataFrame:
    return tree_edges(spark, folder).selectExpr(f"concat('t', {_s('dst')}) AS src_tbl", f"concat('t', {_s('src')}) AS dst_tbl")


def star_columns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(f"concat('t', {_s('c_custkey')}) AS tbl", f"concat('c', {_s('c_nationkey')}) AS col")


STARS_SQL = f"""{TREE_SQL}, stars AS (SELECT concat('t', {_s('dst')}) AS src_tbl, concat('t', {_s('src')}) AS dst_tbl FROM tree),
  cols AS (SELECT concat('t', {_s('c_custkey')}) AS tbl, concat('c', {_s('c_nationkey')}) AS col FROM customer)"""


def star_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Rings of ten supplier tables that copy each other; each also feeds a table of its own."""
    near = _s("s_suppkey")
    far = _s("CAST(floor(s_suppkey / 10) * 10 AS BIGINT) + (s_suppkey + 1) % 10")
    suppliers = table(spark, folder, "supplier")
    ring = suppliers.selectExpr(f"concat('s', {near}) AS src_tbl", f"concat('s', {far}) AS dst_tbl")
    return ring.unionByName(suppliers.selectExpr(f"concat('s', {near}) AS src_tbl", f"concat('below', {near}) AS dst_tbl"))


def ring_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The rings as statements, one per supplier."""
    far = _s("CAST(floor(s_suppkey / 10) * 10 AS BIGINT) + (s_suppkey + 1) % 10")
    made = f"concat('CREATE TABLE lake.s', {far}, ' AS SELECT * FROM lake.s', {_s('s_suppkey')}) AS sql"
    return table(spark, folder, "supplier").selectExpr("s_suppkey AS stmt_id", "s_suppkey AS seq", made)


def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, t).selectExpr(i.format(k=_s(k)), n, f"'{kind}' AS kind") for t, i, k, n, kind in _GRAPH_VERTICES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).selectExpr(s, d, f"'{r}' AS relation") for t, s, d, r in _GRAPH_EDGES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


GRAPH_SQL = (
    "v AS ("
    + " UNION ALL ".join(f"SELECT {i.format(k=_s(k))}, {n}, '{kind}' AS kind FROM {t}" for t, i, k, n, kind in _GRAPH_VERTICES)
    + "), e AS ("
    + " UNION ALL ".join(f"SELECT {s}, {d}, '{r}' AS relation FROM {t}" for t, s, d, r in _GRAPH_EDGES)
    + ")"
)
