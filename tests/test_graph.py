import random

import pytest
from pyspark.sql import functions as F

from headwater.operators import graph, skew, stars
from headwater.operators.numbering import global_row_number


def walk(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        n = todo.pop()
        for s, d in edges:
            if s == n and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("broadcast_rows, at_least", [(200_000, 1_000_000), (0, 5)])
def test_reach_with_hub_and_cycles(spark, monkeypatch, broadcast_rows, at_least):
    monkeypatch.setattr(graph, "FRONTIER_BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(graph, "MERGE_EVERY", 3)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 40)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(110)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    seeds = spark.createDataFrame([(41,), (0,), (200,)], "node bigint")
    down = {r.node for r in graph.reach(df, seeds, "down", at_least).collect()}
    assert down == walk(edges, [41, 0, 200])
    up = [r.node for r in graph.reach(df, seeds, "up", at_least).collect()]
    assert sorted(up) == sorted(walk([(d, s) for s, d in edges], [41, 0, 200]))


def test_hops_are_shortest(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.hops) for r in graph.reach(df, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_lookup_join_splits_hot_keys(spark):
    facts = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(9))], "k string, v int")
    plain = {tuple(r) for r in facts.join(lookup, "k", "left").select("id", "v").collect()}
    assert {tuple(r) for r in skew.lookup_join(facts, lookup, "k", "id", "left", at_least=50).select("id", "v").collect()} == plain
    assert skew.spread(facts, skew.hot_keys(facts, "k", 10), "k", "id").where("k = 'hot'").select("salt").distinct().count() > 5


def test_global_row_number(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = global_row_number(rows, ["x"], "n").collect()
    assert all(r.n == r.x + 1 for r in got) and len(got) == 1000


def test_star_chain_and_rings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("r1", "r2"), ("r2", "r1"), ("r2", "below")], "src_tbl string, dst_tbl string")
    columns = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "*"), ("r1", "z")], "tbl string, col string")
    owned = {(r.tbl, r.col, r.inherited) for r in stars.expand_stars(edges, columns).collect()}
    assert owned == {
        ("a", "x", False), ("b", "x", True), ("c", "x", True), ("b", "y", False), ("c", "y", True),
        ("r1", "z", False), ("r2", "z", True), ("below", "z", True),
    }
    assert {r.tbl for r in stars.unresolvable_stars(edges).collect()} == {"r1", "r2", "below"}


@pytest.mark.parametrize("kind", ["none", "one", "range"])
def test_closures_on_few_edges(spark, tmp_path, kind):
    edges = {
        "none": spark.createDataFrame([(1, 2)], "src long, dst long").where("src > 5"),
        "one": spark.createDataFrame([(0, 1)], "src long, dst long"),
        "range": spark.range(50).selectExpr("id AS src", "id + 1 AS dst"),
    }[kind]
    if kind == "none":
        edges.write.parquet(str(tmp_path / "e"))
        edges = spark.read.parquet(str(tmp_path / "e"))
    seeds = spark.createDataFrame([(0,)], "node long")
    found = {r.node for r in graph.downstream_closure(edges, seeds).collect()}
    assert found == set(range({"none": 1, "one": 2, "range": 51}[kind]))


def test_hot_keys_have_no_limit(spark):
    rows = spark.range(3000).selectExpr("id % 1500 AS k", "id AS v").unionByName(spark.range(40).selectExpr("7L AS k", "id AS v"))
    hot = {r.k: r.salts for r in skew.hot_keys(rows, "k", 2).collect()}
    assert len(hot) == 1500 and hot[7] == 22 and hot[8] == 2
    joined = skew.lookup_join(rows, spark.range(1500).selectExpr("id AS k", "-id AS w"), "k", "v", at_least=2)
    assert joined.where("w = -k").count() == 3040
