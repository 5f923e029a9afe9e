"""The relational work that the script corpus describes, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.operators import relational as rel
from headwater.operators.numbering import global_row_number
from headwater.operators.staging import Stages
from headwater.plans.registry import query, table


def _sum_sql(amount: str) -> str:
    return f"CAST(sum(CAST({amount} AS DECIMAL(15,2))) AS DOUBLE)"


@query("project_rename", "SELECT o_orderkey AS project_id, o_custkey AS client_id, o_orderstatus AS status, o_totalprice AS amount FROM orders")
def project_rename(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("client_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount")
    )


@query(
    "filter_predicates",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F' AND l_shipdate IS NOT NULL",
)
def filter_predicates(spark, folder):
    kept = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") != "F") & F.col("l_shipdate").isNotNull()
    return table(spark, folder, "lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "inner_join_chain",
    """SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def inner_join_chain(spark, folder):
    t = lambda name: table(spark, folder, name)
    homes = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clients = t("customer").join(homes, F.col("c_nationkey") == F.col("n_nationkey"))
    placed = t("orders").join(clients, F.col("o_custkey") == F.col("c_custkey"))
    return t("lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query(
    "multi_key_join",
    f"""SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, t.qty FROM lineitem l JOIN
        (SELECT l_orderkey, l_partkey, l_suppkey, {_sum_sql('l_quantity')} AS qty FROM lineitem GROUP BY ALL) t
        ON l.l_orderkey = t.l_orderkey AND l.l_partkey = t.l_partkey AND l.l_suppkey = t.l_suppkey""",
)
def multi_key_join(spark, folder):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    lines = table(spark, folder, "lineitem")
    totals = lines.groupBy(*keys).agg(rel.exact_sum("l_quantity").alias("qty"))
    return lines.select(*keys, "l_linenumber").join(totals, keys)


@query(
    "left_join_on_constant",
    "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'",
)
def left_join_on_constant(spark, folder):
    customer = table(spark, folder, "customer")
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_mktsegment") == "BUILDING")
    return table(spark, folder, "orders").join(customer, on, "left").select("o_orderkey", "c_name")


_BUCKET = "CAST({0}_nationkey * 100 + floor({0}_acctbal / 500) AS BIGINT) AS bucket"


@query(
    "full_outer_key_merge",
    f"""SELECT coalesce(a.bucket, b.bucket) AS bucket, n_customers, n_suppliers FROM
        (SELECT {_BUCKET.format('c')}, count(*) AS n_customers FROM customer GROUP BY ALL) a FULL JOIN
        (SELECT {_BUCKET.format('s')}, count(*) AS n_suppliers FROM supplier GROUP BY ALL) b ON a.bucket = b.bucket""",
)
def full_outer_key_merge(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(_BUCKET.format("c")).groupBy("bucket").agg(F.count("*").alias("n_customers"))
    suppliers = table(spark, folder, "supplier").selectExpr(_BUCKET.format("s")).groupBy("bucket").agg(F.count("*").alias("n_suppliers"))
    return rel.full_key_merge(customers, suppliers, "bucket")


@query(
    "full_outer_multiway",
    f"""SELECT a.bucket, n_rich, n_suppliers, n_building, n_all FROM
        (SELECT {_BUCKET.format('c')}, count(*) AS n_rich FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) a
        FULL JOIN (SELECT {_BUCKET.format('s')}, count(*) AS n_suppliers FROM supplier GROUP BY ALL) b ON a.bucket = b.bucket
        FULL JOIN (SELECT {_BUCKET.format('c')}, count(*) AS n_building FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL) c ON a.bucket = c.bucket
        FULL JOIN (SELECT {_BUCKET.format('c')}, count(*) AS n_all FROM customer GROUP BY ALL) d ON a.bucket = d.bucket""",
)
def full_outer_multiway(spark, folder):
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    count = lambda df, p, name: df.selectExpr(_BUCKET.format(p)).groupBy("bucket").agg(F.count("*").alias(name))
    parts = [
        count(customer.where("c_acctbal > 5000"), "c", "n_rich"),
        count(supplier, "s", "n_suppliers"),
        count(customer.where("c_mktsegment = 'BUILDING'"), "c", "n_building"),
        count(customer, "c", "n_all"),
    ]
    return rel.full_chain_on_first(parts, "bucket")


@query(
    "dimension_roles_join",
    """SELECT l_orderkey, l_linenumber, b.n_name AS buyer_nation, s.n_name AS seller_nation FROM lineitem
       LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation b ON c_nationkey = b.n_nationkey
       LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey""",
)
def dimension_roles_join(spark, folder):
    t = lambda name: table(spark, folder, name)
    role = lambda key, name: t("nation").select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(role("c_nationkey", "buyer_nation"), "c_nationkey", "left")
        .join(role("s_nationkey", "seller_nation"), "s_nationkey", "left")
        .select("l_orderkey", "l_linenumber", "buyer_nation", "seller_nation")
    )


@query("cross_join", "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey")
def cross_join(spark, folder):
    """Relations listed with a comma, tied together by WHERE; planned as an ordinary join."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation).where(F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("cross_product", "SELECT r_name, n_name FROM region, nation")
def cross_product(spark, folder):
    """Relations listed with a comma and no condition: a product."""
    return rel.product(table(spark, folder, "region").select("r_name"), table(spark, folder, "nation").select("n_name"))


@query(
    "group_sum_avg",
    f"""SELECT l_returnflag, l_linestatus, {_sum_sql('l_extendedprice')} AS sum_price, {_sum_sql('l_quantity')} AS sum_qty,
        {_sum_sql('l_tax')} / count(l_tax) / 100 AS avg_tax_rate FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def group_sum_avg(spark, folder):
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        rel.exact_sum("l_extendedprice").alias("sum_price"),
        rel.exact_sum("l_quantity").alias("sum_qty"),
        (rel.exact_sum("l_tax") / F.count("l_tax") / 100).alias("avg_tax_rate"),
    )


@query(
    "sum_of_product",
    f"SELECT l_suppkey, {_sum_sql('CASE l_returnflag WHEN ' + chr(39) + 'R' + chr(39) + ' THEN -1 ELSE 1 END * l_extendedprice')} AS net_amount FROM lineitem GROUP BY l_suppkey",
)
def sum_of_product(spark, folder):
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return table(spark, folder, "lineitem").groupBy("l_suppkey").agg(rel.exact_sum(sign * F.col("l_extendedprice")).alias("net_amount"))


@query(
    "min_max_count",
    "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS min_value, max(value) AS max_value, count(event_id) AS n_events FROM events GROUP BY user_id",
)
def min_max_count(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("event_id").alias("n_events")
    )


@query("count_distinct", "SELECT o_custkey, count(DISTINCT o_orderdate) AS n_dates FROM orders GROUP BY o_custkey")
def count_distinct(spark, folder):
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderdate").alias("n_dates"))


@query(
    "span_rate",
    """WITH span AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(DISTINCT o_orderdate) AS n FROM orders GROUP BY o_custkey),
       m AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) AS whole,
             day(a) = day(b) OR (day(a) = day(last_day(a)) AND day(b) = day(last_day(b))) AS even FROM span),
       months AS (SELECT *, CASE WHEN even THEN whole ELSE floor((whole + (day(b) - day(a)) * 86400.0::DOUBLE / (31 * 86400.0::DOUBLE)) * 1e8 + 0.5) / 1e8 END + 1 AS n_months FROM m)
       SELECT o_custkey, CAST(n_months AS DOUBLE) AS n_months, n AS n_dates, n / CAST(n_months AS DOUBLE) * 12 AS dates_per_year FROM months""",
)
def span_rate(spark, folder):
    span = table(spark, folder, "orders").groupBy("o_custkey").agg(
        (F.months_between(F.max("o_orderdate"), F.min("o_orderdate")) + 1).alias("n_months"), F.count_distinct("o_orderdate").alias("n_dates")
    )
    return span.withColumn("dates_per_year", F.col("n_dates") / F.col("n_months") * 12)


@query(
    "latest_row_join_back",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
       JOIN (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) ON o_custkey = k AND o_orderdate = d""",
)
def latest_row_join_back(spark, folder):
    return rel.latest_rows(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", "o_orderdate")


@query(
    "max_then_min_tiebreak",
    """SELECT l.l_orderkey, l.l_quantity, min(l_partkey) AS l_partkey FROM lineitem l
       JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) t ON l.l_orderkey = t.l_orderkey AND l.l_quantity = q
       GROUP BY l.l_orderkey, l.l_quantity""",
)
def max_then_min_tiebreak(spark, folder):
    return rel.top_then_least(table(spark, folder, "lineitem"), "l_orderkey", "l_quantity", "l_partkey")


@query(
    "first_line_metrics",
    """SELECT l_orderkey, l_partkey, CAST(l_extendedprice + l_tax AS DECIMAL(15,2)) AS first_amount,
       CAST((l_extendedprice + l_tax) / o_totalprice AS DECIMAL(15,6)) AS first_ratio
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_suppkey <> -1""",
)
def first_line_metrics(spark, folder):
    first = table(spark, folder, "lineitem").where("l_linenumber = 1 AND l_returnflag = 'R' AND l_suppkey <> -1")
    joined = first.join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    amount = F.col("l_extendedprice") + F.col("l_tax")
    return joined.select("l_orderkey", "l_partkey", rel.money(amount).alias("first_amount"), rel.money(amount / F.col("o_totalprice"), 15, 6).alias("first_ratio"))


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark, folder):
    return table(spark, folder, "orders").select("o_custkey", "o_orderstatus").distinct()


@query(
    "union_then_aggregate",
    f"""SELECT l_suppkey, CAST(sum(amount) AS DOUBLE) AS amount FROM (
        SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS amount, count(*) AS n, 'price' AS flow FROM lineitem GROUP BY l_suppkey
        UNION SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(15,2))), count(*), l_returnflag FROM lineitem GROUP BY l_suppkey, l_returnflag)
        GROUP BY l_suppkey""",
)
def union_then_aggregate(spark, folder):
    lines = table(spark, folder, "lineitem")
    totals = lambda keys, amount, flow: lines.groupBy(*keys).agg(F.sum(rel.money(amount)).alias("amount"), F.count("*").alias("n")).select("l_suppkey", "amount", "n", flow.alias("flow"))
    both = totals(["l_suppkey"], "l_extendedprice", F.lit("price")).union(totals(["l_suppkey", "l_returnflag"], "l_quantity", F.col("l_returnflag")))
    return both.distinct().groupBy("l_suppkey").agg(F.sum("amount").cast("double").alias("amount"))


@query(
    "case_simple_map",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'simple' WHEN 'F' THEN 'simple' ELSE 'complex' END AS complexity FROM orders",
)
def case_simple_map(spark, folder):
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select("o_orderkey", F.when(status == "O", "simple").when(status == "F", "simple").otherwise("complex").alias("complexity"))


@query(
    "case_searched",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'red' WHEN o_orderpriority = '2-HIGH' THEN 'orange' WHEN o_orderpriority = '5-LOW' THEN 'green' END AS score FROM orders",
)
def case_searched(spark, folder):
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select("o_orderkey", F.when(priority == "1-URGENT", "red").when(priority == "2-HIGH", "orange").when(priority == "5-LOW", "green").alias("score"))


@query(
    "in_list_range_bucket",
    """SELECT p_partkey, CASE WHEN p_brand IN ('', 'Brand#1', 'Brand#2', 'Brand#3') THEN 'others' WHEN p_brand IN ('Brand#5') THEN 'house'
       WHEN p_brand >= 'Brand#11' AND p_brand <= 'Brand#19' THEN 'network' ELSE p_brand END AS channel FROM part""",
)
def in_list_range_bucket(spark, folder):
    brand = F.col("p_brand")
    label = (
        F.when(brand.isin("", "Brand#1", "Brand#2", "Brand#3"), "others")
        .when(brand.isin("Brand#5"), "house")
        .when(brand.between("Brand#11", "Brand#19"), "network")
        .otherwise(brand)
    )
    return table(spark, folder, "part").select("p_partkey", label.alias("channel"))


@query("sentinel_to_null", "SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders")
def sentinel_to_null(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))


@query(
    "null_default",
    """SELECT o_orderkey, CASE WHEN c_acctbal IS NOT NULL THEN c_acctbal / 100 ELSE 0.0 END AS balance_rate FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'MACHINERY'""",
)
def null_default(spark, folder):
    machinery = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY'")
    joined = table(spark, folder, "orders").join(machinery, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.col("c_acctbal") / 100, F.lit(0.0)).alias("balance_rate"))


@query("flag_if", "SELECT p_partkey, CAST(CASE WHEN p_type <> 'ECONOMY' THEN 1 ELSE 0 END AS INT) AS is_other, CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS INT) AS is_large FROM part")
def flag_if(spark, folder):
    flag = lambda cond: F.when(cond, 1).otherwise(0).cast("int")
    return table(spark, folder, "part").select("p_partkey", flag(F.col("p_type") != "ECONOMY").alias("is_other"), flag(F.col("p_size") > 25).alias("is_large"))


_FLAGS = {"bought": "purchase", "signed": "signup", "failed": "error"}


@query(
    "presence_flags",
    """SELECT coalesce(a.user_id, b.user_id, c.user_id) AS user_id, CAST(a.user_id IS NOT NULL AS INT) AS bought, CAST(b.user_id IS NOT NULL AS INT) AS signed, CAST(c.user_id IS NOT NULL AS INT) AS failed
       FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') a
       FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id
       FULL JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') c ON coalesce(a.user_id, b.user_id) = c.user_id""",
)
def presence_flags(spark, folder):
    return rel.presence_flags(table(spark, folder, "events"), "user_id", "event_type", _FLAGS)


@query(
    "cast_decimal",
    """SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS price, CAST(l_discount AS DECIMAL(15,6)) AS discount_rate,
       CAST(l_quantity AS DECIMAL(10,2)) AS quantity FROM lineitem""",
)
def cast_decimal(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", rel.money("l_extendedprice").alias("price"), rel.money("l_discount", 15, 6).alias("discount_rate"), rel.money("l_quantity", 10, 2).alias("quantity")
    )


@query("concat_keys", "SELECT concat('001_', CAST(c_custkey AS STRING)) AS id, concat(c_name, ' ', c_mktsegment) AS label FROM customer")
def concat_keys(spark, folder):
    return table(spark, folder, "customer").select(
        F.concat(F.lit("001_"), F.col("c_custkey").cast("string")).alias("id"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("label")
    )


@query(
    "pro_rata_share",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_quantity / 50.0::DOUBLE ELSE l_extendedprice END AS share FROM lineitem",
)
def pro_rata_share(spark, folder):
    share = F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice") * F.col("l_quantity") / 50.0).otherwise(F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", share.alias("share"))


@query(
    "rounded_ratio_guard",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN round(l_extendedprice / 12::DOUBLE * l_quantity, 6)
       ELSE round(l_discount * l_extendedprice / (l_quantity + l_extendedprice / 12::DOUBLE), 6) END AS ratio FROM lineitem""",
)
def rounded_ratio_guard(spark, folder):
    price, qty, disc = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")
    ratio = F.when(disc == 0, F.round(price / 12 * qty, 6)).otherwise(F.round(disc * price / (qty + price / 12), 6))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))


_TIMES = {"created_at": ("signup", "min"), "edited_at": ("view", "min"), "signed_at": ("click", "min"), "started_at": ("purchase", "max")}
_TIMES_SQL = ", ".join(f"{how}(ts) FILTER (event_type = '{kind}') AS {name}" for name, (kind, how) in _TIMES.items())
_CHAIN_SQL = f"""chain AS (SELECT user_id, coalesce(created_at, edited_at, signed_at, started_at) AS created_nn, coalesce(edited_at, signed_at, started_at) AS edited_nn,
  coalesce(signed_at, started_at) AS signed_nn, started_at AS started_nn FROM (SELECT user_id, {_TIMES_SQL} FROM events GROUP BY user_id))"""


def _times(spark, folder):
    return rel.pivot_times(table(spark, folder, "events"), "user_id", "event_type", "ts", _TIMES)


def _chain(spark, folder):
    names = list(_TIMES)
    nn = lambda i: F.coalesce(*names[i:]).alias(names[i].replace("_at", "_nn"))
    return _times(spark, folder).select("user_id", *(nn(i) for i in range(len(names))))


@query("event_pivot_dates", f"SELECT user_id, {_TIMES_SQL} FROM events GROUP BY user_id")
def event_pivot_dates(spark, folder):
    return _times(spark, folder)


@query("fallback_chain", f"WITH {_CHAIN_SQL} SELECT * FROM chain")
def fallback_chain(spark, folder):
    return _chain(spark, folder)


def _delay_sql(later: str, earlier: str, name: str) -> str:
    seconds = f"(CAST(floor(epoch({later})) AS BIGINT) - CAST(floor(epoch({earlier})) AS BIGINT))"
    in_order = f"date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE)) >= 0"
    return f"CAST(CASE WHEN {in_order} THEN CAST({seconds} / 60 / 60 / 24 AS DECIMAL(15,1)) ELSE 0 END AS DECIMAL(15,1)) AS {name}"


@query(
    "stage_delays",
    f"""WITH {_CHAIN_SQL} SELECT user_id, {_delay_sql('edited_nn', 'created_nn', 'edit_delay')},
        {_delay_sql('signed_nn', 'edited_nn', 'sign_delay')}, {_delay_sql('started_nn', 'signed_nn', 'start_delay')} FROM chain""",
)
def stage_delays(spark, folder):
    return _chain(spark, folder).select(
        "user_id",
        rel.stage_delay("edited_nn", "created_nn").alias("edit_delay"),
        rel.stage_delay("signed_nn", "edited_nn").alias("sign_delay"),
        rel.stage_delay("started_nn", "signed_nn").alias("start_delay"),
    )


@query(
    "order_derived",
    "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC) t",
)
def order_derived(spark, folder):
    counted = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    # The key parts equal counts, of which there are few, into even ranges.
    return counted.orderBy(F.desc("n"), "o_custkey").select("o_custkey", "n")


@query(
    "star_plus_columns",
    "SELECT o.*, c_name, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS is_large FROM orders o JOIN customer ON o_custkey = c_custkey",
)
def star_plus_columns(spark, folder):
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*orders.columns, "c_name", F.when(F.col("o_totalprice") > 100000, 1).otherwise(0).alias("is_large"))


@query("global_row_number", "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS id FROM customer")
def numbered_customers(spark, folder):
    return global_row_number(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "id")


@query(
    "staged_tables",
    """WITH latest AS (SELECT o_custkey, max(o_totalprice) AS price FROM orders
         JOIN (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) ON o_custkey = k AND o_orderdate = d GROUP BY o_custkey)
       SELECT coalesce(o_custkey, c_custkey) AS custkey, CAST(price AS DECIMAL(15,2)) AS last_amount, CAST(c_acctbal AS DECIMAL(15,2)) AS balance
       FROM latest FULL JOIN customer ON o_custkey = c_custkey""",
)
def staged_tables(spark, folder):
    """Three tables, each built from the stored one before it."""
    stages = Stages(spark)
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    latest = stages.create("latest", rel.latest_rows(orders, "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("custkey")).agg(F.max("o_totalprice").alias("price")))
    customer = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), "c_acctbal")
    merged = stages.create("merged", rel.full_key_merge(latest, customer, "custkey"))
    return stages.create("final", merged.select("custkey", rel.money("price").alias("last_amount"), rel.money("c_acctbal").alias("balance")))


@query(
    "insert_select",
    """SELECT o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'""",
)
def insert_select(spark, folder):
    """Rows appended to a stored table, matched by column name."""
    stages = Stages(spark)
    picked = table(spark, folder, "orders").select(F.col("o_totalprice").alias("amount"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    stages.create("closed", picked.where("o_orderstatus = 'F'").select("id", "amount"))
    return stages.insert("closed", picked.where("o_orderstatus = 'O'"))
