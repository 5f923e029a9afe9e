import re

import pytest
from pyspark.sql import functions as F

from headwater import lineage_from_sql
from headwater.api import lineage_result, load_state, read_lineage, save_state
from headwater.operators import catalog, facts
from headwater.operators.lineage import token_links, with_full_names

# statement, links that must be there, full names that must be there, links that must not be
CASES = [
    ("select rainfall from gauges", [], ["gauges.rainfall"], []),
    ("select height from GEO.Peaks", [], ["geo.peaks.height"], []),
    ("select height as metres from peaks", [("peaks.height", "metres")], [], []),
    ("create table totals as select weight from parcels", [("parcels.weight", "totals.weight")], [], []),
    ("select crew.duty from ships, crew", [], ["crew.duty"], []),
    ("select c.duty from ships, crew c", [("crew.duty", "c.duty")], [], []),
    ("SELECT P.Mass, p.orbit, moon.size, MOON.age FROM planets P, moon", [("planets.mass", "p.mass")], ["p.orbit", "moon.size", "moon.age"], []),
    ("SELECT CASE grade WHEN 'Pass' THEN 10 WHEN 'Fail' THEN 20 END AS points FROM exams", [("exams.grade", "points"), ("pass", "points"), ("20", "points")], [], []),
    ("SELECT CASE WHEN paid IS NULL THEN due ELSE refund END FROM bills", [("bills.paid", "unresolvedalias"), ("bills.due", "unresolvedalias")], [], [("bills.refund", "unresolvedalias")]),
    ("SELECT town, MIN(age) AS youngest FROM census.people GROUP BY town", [("census.people.age", "min()"), ("min()", "youngest")], [], [("census.people.age", "youngest")]),
    ("CREATE TABLE census.towns AS SELECT town, AVG(age) AS mean_age FROM census.people GROUP BY town", [("census.people.age", "avg()"), ("avg()", "mean_age"), ("mean_age", "census.towns.mean_age")], [], []),
    ("CREATE TABLE zoo.kinds AS SELECT DISTINCT k.genus AS kind FROM zoo.animals k", [("zoo.animals.genus", "k.genus"), ("k.genus", "kind"), ("kind", "zoo.kinds.kind")], [], []),
    ("CREATE TABLE race.lanes SELECT DISTINCT dense_rank() OVER (ORDER BY t) AS lane FROM race.heats", [("dense_rank()", "lane"), ("lane", "race.lanes.lane")], [], []),
    ("INSERT INTO port.log SELECT s.berth FROM port.ships s", [("port.ships.berth", "s.berth"), ("s.berth", "port.log.berth")], [], []),
    ("INSERT OVERWRITE TABLE port.log PARTITION (d='x') SELECT s.berth FROM port.ships s", [("s.berth", "port.log.berth")], [], []),
    (
        "CREATE TABLE mail.sent AS SELECT code FROM (SELECT code FROM mail.letters UNION SELECT code FROM mail.cards) m",
        [("mail.cards.code", "code"), ("mail.letters.code", "code"), ("code", "m.code"), ("m.code", "mail.sent.code")], [], [],
    ),
    # Brackets around relations: without a name, with one, on the right side, inside each other, after a comma.
    ("SELECT oak.age, elm.age AS elm_age FROM (wood.oak JOIN wood.elm ON oak.plot = elm.plot)", [("wood.elm.age", "elm_age")], ["wood.oak.age"], [("elm.age", "elm_age")]),
    ("SELECT grove.age, shade FROM (wood.oak JOIN wood.elm ON oak.plot = elm.plot) grove", [("wood.oak.age", "grove.age")], ["wood.elm", "shade"], [("wood.elm.age", "grove.age")]),
    ("SELECT f.len, g.len AS glen, h.len AS hlen FROM sea.fish f LEFT JOIN (sea.gulls g JOIN sea.hake h ON g.id = h.id) ON f.id = g.id WHERE (f.len) > 2", [("sea.gulls.len", "g.len"), ("g.len", "glen"), ("h.len", "hlen")], ["f.len"], []),
    ("INSERT INTO sky.out SELECT z.v FROM ((sky.sun s JOIN sky.moon m ON s.d = m.d) inner_pair JOIN sky.star t ON inner_pair.d = t.d) z", [("sky.sun.v", "z.v"), ("z.v", "sky.out.v")], ["sky.star"], [("sky.sun.v", "inner_pair.v")]),
    ("SELECT a1.w, b1.w AS w2 FROM tea.a1, (tea.b1 JOIN tea.c1 x ON b1.k = x.k)", [("tea.b1.w", "w2")], ["tea.a1.w", "tea.c1"], []),
    ("SELECT d.hue, p.hue AS phue FROM ((SELECT max(hue) AS hue FROM ink.dyes) d JOIN ink.pens p ON d.k = p.k)", [("max()", "hue"), ("hue", "d.hue"), ("p.hue", "phue")], [], []),
    ("SELECT (n.one), round(n.two, (n.three)) AS r, (n.four + n.five) * 2 s FROM num.n n", [("n.three", "round()"), ("n.five", "s"), ("2", "s")], ["n.one"], [("n.three", "r")]),
    # Intervals are one literal; fields of structs belong to their column.
    ("SELECT e.day + INTERVAL 3 DAYS AS due, interval '2' hours AS span, 7 days FROM cal.events e", [("e.day", "due"), ("interval 3 days", "due"), ("interval 2 hours", "span"), ("7", "days")], [], [("cal.events.days", "due"), ("3", "due")]),
    ("SELECT u.home.street AS st, geo.pt.lat AS lat, org.geo.pt.lon AS lon, u.id FROM org.users u, org.geo", [("u.home", "st"), ("org.users.home", "u.home"), ("org.geo.pt", "lat"), ("org.geo.pt", "lon")], ["u.id"], []),
    ("SELECT box.side AS s FROM toys.cubes", [("toys.cubes.box", "s")], [], []),
    # A number that a derived table makes is read by the call around the derived table.
    (
        "SELECT upper(seat) AS label, zone FROM (SELECT lpad(rank() OVER (ORDER BY z.price), 4) AS seat, z.zone FROM hall.plan z) picked",
        [("rank()", "lpad()"), ("4", "lpad()"), ("lpad()", "seat"), ("seat", "picked.seat"), ("picked.seat", "upper()"), ("upper()", "label"), ("z.zone", "picked.zone")],
        [], [("z.price", "rank()"), ("rank()", "seat")],
    ),
    # A literal and a column meet in one call; a cast passes its operand on.
    ("CREATE TABLE shop.tags AS SELECT replace(p.code, '-', p.sep) AS tag, CAST(p.weight AS FLOAT) kg FROM shop.parts p", [("p.code", "replace()"), ("-", "replace()"), ("p.sep", "replace()"), ("replace()", "tag"), ("p.weight", "kg"), ("kg", "shop.tags.kg")], [], [("float", "kg")]),
    # Calls in calls keep their own inputs, arithmetic joins them in the output.
    (
        "CREATE TABLE lab.drift AS SELECT 100 * stddev(r.temp) - abs(least(r.lo, floor(r.hi))) AS score FROM lab.reads r WHERE r.ok > 0 GROUP BY r.day",
        [("r.temp", "stddev()"), ("stddev()", "score"), ("r.hi", "floor()"), ("floor()", "least()"), ("r.lo", "least()"), ("least()", "abs()"), ("abs()", "score"), ("100", "score"), ("score", "lab.drift.score")],
        [], [("r.ok", "score"), ("r.day", "score"), ("floor()", "abs()"), ("least()", "score")],
    ),
    # A derived table of a derived table on one side of a full outer join, a table on the other.
    (
        "INSERT INTO fleet.report SELECT coalesce(w.van, k.van) AS van, CASE WHEN w.km > 9 THEN k.fuel END AS used "
        "FROM (SELECT g.van, g.km * 2 AS km FROM (SELECT van, sum(leg) AS km FROM fleet.trips WHERE done = 1 GROUP BY van) g) w "
        "FULL JOIN fleet.tanks k ON w.van = k.van AND k.day > 3",
        [("fleet.trips.leg", "sum()"), ("sum()", "km"), ("g.km", "km"), ("2", "km"), ("km", "w.km"), ("w.km", "used"), ("fleet.tanks.fuel", "k.fuel"), ("k.fuel", "used"), ("used", "fleet.report.used"), ("w.van", "coalesce()"), ("coalesce()", "van")],
        [], [("k.day", "used"), ("fleet.trips.done", "km")],
    ),
    ("SELECT a.x IN (SELECT max(k) FROM q) AS h, a.y FROM t a WHERE a.z IN (SELECT w FROM q2)", [("a.x", "h")], ["a.y"], [("max()", "h")]),
    ("SELECT `t`.`My Col` AS c, -1 AS neg, a * b FROM db.`t`", [("db.t.my col", "c"), ("1", "neg"), ("db.t.a", "unresolvedalias")], [], []),
    ("SELECT count(*) AS n FROM t", [("1", "count()"), ("count()", "n")], [], []),
    ("(SELECT a FROM x.t) UNION ALL (SELECT b FROM x.u)", [("x.t.a", "a"), ("x.u.b", "a")], [], []),
    ("SELECT date '2020-01-01' AS d, if(a > 1, b, 'from') x FROM t", [("2020-01-01", "d"), ("t.a", "if()"), ("if()", "x"), ("from", "if()")], [], []),
    ("SELECT a * 1e-5 AS x, b + .5 AS y, c - 2.5E+3 AS z FROM db.t", [("1e-5", "x"), (".5", "y"), ("2.5e+3", "z"), ("db.t.a", "x")], [], [("5", "x"), ("5", "y"), ("db.t.1e", "x")]),
    ("SELECT f(g(a), f(b)) AS o /* from nowhere */ FROM t", [("t.a", "g()"), ("g()", "f()"), ("t.b", "f()"), ("f()", "f()"), ("f()", "o")], [], []),
]


@pytest.fixture(scope="module")
def flows(spark):
    rows = [(i, i, case[0]) for i, case in enumerate(CASES)]
    links = with_full_names(token_links(spark.createDataFrame(rows, "stmt_id bigint, seq bigint, sql string"))).collect()
    found = {}
    for r in links:
        found.setdefault(r.stmt_id, []).append((r.src, r.dst))
    return found


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0][:40] for c in CASES])
def test_statement(flows, i):
    _, linked, named, apart = CASES[i]
    found = flows[i]
    names = {end for pair in found for end in pair}
    assert [p for p in linked if p not in found] == []
    assert [n for n in named if n not in names] == []
    assert [p for p in apart if p in found] == []


def edges_of(result):
    name = lambda side: result.vertices.select(F.col("id").alias(side), F.col("full_name").alias(f"{side}_name"))
    joined = result.edges.join(name("src"), "src").join(name("dst"), "dst")
    return {(r.src_name, r.relation, r.dst_name) for r in joined.collect()}


def test_corpus_order_stars_and_copies(spark):
    result = lineage_from_sql(
        spark,
        [
            "create table lib.loan as select * from lib.book",
            "select a, b from lib.book",
            "create table lib.copy like lib.book",
            "create table lib.copy2 like lib.copy",
            "select late from lib.book",
            "create table lib.out as select v.* from lib.loan v",
            "CREATE EXTERNAL TABLE ext (Code STRING, parts STRUCT<a:INT,b:ARRAY<INT>>, tags MAP<STRING,INT>, price DECIMAL(12,3)) PARTITIONED BY (DAY STRING) LOCATION '/data/ext'",
            "drop table if exists lib.gone",
            "select * from (select p, q from src.t) sub",
            "create table lib.amb as select a, zz from lib.book x, src.other",
        ],
    )
    names = {(r.kind, r.full_name) for r in result.vertices.collect()}
    edges = edges_of(result)
    for col in ("a", "b", "late"):
        assert ("lib.book." + col, "used for", "lib.loan." + col) in edges
        assert ("lib.loan." + col, "used for", "v." + col) in edges
        assert ("v." + col, "used for", "lib.out." + col) in edges
    assert {("column", "lib.copy.a"), ("column", "lib.copy2.b")} <= names
    assert ("column", "lib.copy.late") not in names and ("column", "lib.copy2.late") not in names
    assert {n for _, n in names if n.startswith("ext.")} == {"ext.code", "ext.parts", "ext.tags", "ext.price", "ext.day"}
    assert not any("gone" in n or n.endswith("*") for _, n in names)
    assert ("lib.book.a", "used for", "lib.amb.a") in edges
    assert ("zz", "used for", "lib.amb.zz") in edges
    assert ("lib", "contains", "lib.loan") in edges and ("lib.loan", "contains", "lib.loan.a") in edges
    assert {(r.src.col, r.n_owners) for r in result.loose.collect()} == {("a", 1), ("zz", 0)}


def test_text_of_several_lines(spark):
    result = lineage_from_sql(spark, ["create table m.a as select k.tin, -- note; with a cut\n l.lid\n from b.cans k join b.tops l"])
    names = {r.full_name for r in result.vertices.collect()}
    assert {"b.cans.tin", "b.tops.lid", "m.a.tin", "m.a.lid"} <= names


def test_every_statement_is_linked_or_listed(spark):
    result = lineage_from_sql(
        spark,
        [
            "create table m.a as select v from raw.s limit 5",
            "create table m.b as select w from raw.s",
            "merge into m.c using raw.s",
            "create table m.s as select * from p.x union select * from p.y",
            "create table m.r1 as select * from m.r2",
            "create table m.r2 as select * from m.r1",
        ],
    )
    order = {r.seq: n for n, r in enumerate(result.rejects.orderBy("seq").collect())}
    assert len(order) == 2 and {r.reason for r in result.rejects.collect()} == {"limit", "statement"}
    stars = {(r.src, r.reason) for r in result.unresolved_stars.collect()}
    assert {s for s in stars if s[1] == "cycle"} == {("m.r1.*", "cycle"), ("m.r2.*", "cycle")}
    assert {s for s, reason in stars if reason != "cycle"} >= {"p.x.*"}
    assert result.missing is None


def test_nothing_from_commands(spark):
    result = lineage_from_sql(spark, ["drop table IF EXISTS attic", "CREATE DATABASE IF NOT EXISTS x LOCATION '/y'", "set a=b"])
    assert result.vertices.count() == 0 and result.edges.count() == 0


def test_else_view(spark):
    df = spark.createDataFrame([(1, 1, "SELECT CASE WHEN a THEN b ELSE f(CASE WHEN c THEN d ELSE e END) END AS x FROM t")], "stmt_id bigint, seq bigint, sql string")
    names = lambda with_else: sorted(r.name for r in facts.item_references(df, with_else).collect())
    assert names(False) == ["a", "b"]
    assert names(True) == ["a", "b", "c", "d", "e", "f()"]


def test_rejects(spark):
    sqls = ["MERGE INTO t USING s", "SELECT a FROM t LIMIT 5", "SELECT a FROM t LATERAL VIEW explode(b) c AS d", "WITH q AS (SELECT 1) SELECT 2", "SELECT 'limit 5' FROM t",
            "SELECT sum(a.x) FILTER (WHERE a.y > 1) FROM t a", "SELECT a + interval 1 day 2 hours FROM t", "SELECT interval '1-2' year to month", "SELECT interval 3 days, filter FROM t"]
    df = spark.createDataFrame(list(enumerate(sqls)), "stmt_id bigint, sql string")
    got = {r.reason: r.n_statements for r in facts.reject_report(df).collect()}
    assert got == {"statement": 2, "limit": 1, "lateral view": 1, "filter clause": 1, "interval": 2}


MERGED = [
    "create table lib.loan as select * from lib.book", "select a, b from lib.book", "create table lib.copy like lib.book", "create table lib.copy2 like lib.copy",
    "select late from lib.book", "create table lib.out as select v.* from lib.loan v", "create table w.t (p int, q string)", "select p, r, a from lib.book, w.t",
    "create table w.u like w.t", "insert into w.u select q, late from lib.out, w.t", "select r from w.t", "select p, a from w.u, lib.copy2", "create table w.v as select * from w.u", "merge into x using y",
]


def result_rows(result):
    rows = lambda df: sorted(map(str, df.collect()))
    return [rows(getattr(result, n)) for n in ("vertices", "edges", "columns", "loose", "rejects", "unresolved_stars")]


@pytest.mark.parametrize("cut", ["odd", "later"])
def test_batches_equal_one_run(spark, tmp_path, cut):
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate(MERGED)], "stmt_id bigint, seq bigint, sql string")
    in_first = {"odd": F.col("seq") % 2 == 1, "later": F.col("seq") >= 5}[cut]
    state = read_lineage(rows.where(in_first))
    save_state(state, str(tmp_path / "state"))
    both = read_lineage(rows.where(~in_first), earlier=load_state(spark, str(tmp_path / "state")))
    assert result_rows(lineage_result(both)) == result_rows(lineage_result(read_lineage(rows)))
    assert result_rows(lineage_result(read_lineage(rows.limit(0), earlier=both))) == result_rows(lineage_result(both))


def test_insert_by_place(spark):
    sqls = [
        "create table s.a (one int, two string) partitioned by (day string)", "create table s.b like s.a", "create table s.c like s.b",
        "insert into s.c select x.two, x.one, x.d from r.x x", "create table s.d as select k as first, max(v) as second from r.y group by k",
        "insert into s.d select p + 1, q from r.z union select m, n from r.w", "insert into s.d select z.k, z.*, z.m from r.z z", "insert into s.unknown select u from r.u",
        "create table s.a (three int)", "create table s.e like s.a", "insert overwrite table s.e partition (day='1') select w from r.v", "insert into nodb select o from r.o",
    ]
    df = spark.createDataFrame(list(enumerate(sqls)), "stmt_id bigint, sql string").withColumn("seq", F.col("stmt_id"))
    placed = catalog.place_columns(token_links(df, by_place=True), catalog.table_schemas(df))
    got = {(r.stmt_id, r.src, r.dst) for r in with_full_names(placed).where("dst IS NOT NULL").collect()}
    assert {(3, "x.two", "s.c.one"), (3, "x.one", "s.c.two"), (3, "x.d", "s.c.day")} <= got
    assert {(5, "unresolvedalias", "s.d.first"), (5, "q", "s.d.second")} <= got
    assert {(6, "z.k", "s.d.first"), (6, "z.*", "s.d.*"), (6, "z.m", "s.d.m")} <= got
    assert {(7, "r.u.u", "s.unknown.u"), (10, "r.v.w", "s.e.three"), (11, "r.o.o", "nodb.o")} <= got
    assert not any("\u0002" in d for _, _, d in got)
    by_name = {(r.stmt_id, r.src, r.dst) for r in with_full_names(token_links(df)).where("dst IS NOT NULL").collect()}
    assert (3, "x.two", "s.c.two") in by_name and {g for g in got if g[0] in (4, 7, 11)} == {g for g in by_name if g[0] in (4, 7, 11)}


def test_packed_ends_are_cut_once(spark, capsys):
    statements = spark.createDataFrame([(1, 1, "insert into m.t select a.x as y from r.s a")], "stmt_id bigint, seq bigint, sql string")
    token_links(statements).explain()
    assert len(re.findall(r"split\((?:src|dst)#", capsys.readouterr().out)) == 2
