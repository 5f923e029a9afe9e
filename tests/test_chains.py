import random

import pytest

from headwater.operators import catalog, doubling, graph, stars


@pytest.fixture
def rounds(monkeypatch):
    """Counts the stored intermediate tables."""
    made = []
    for module in (doubling, stars, catalog, graph):
        for name in ("materialize", "materialize_layout"):
            if hasattr(module, name):
                kept = getattr(module, name)
                monkeypatch.setattr(module, name, lambda *a, kept=kept: (made.append(1), kept(*a))[1])
    return made


def peeled(edges):
    while True:
        kept = {e for e in edges if e[0] in {d for _, d in edges}}
        if kept == edges:
            return {d for _, d in edges}
        edges = kept


def stuck(spark, edges):
    df = spark.createDataFrame(sorted(edges), "src_tbl string, dst_tbl string")
    return {r.tbl for r in stars.unresolvable_stars(df).collect()}


def test_long_chain_of_stars(spark, rounds):
    edges = {(f"c{i}", f"c{i + 1}") for i in range(10_000)} | {("x", "y"), ("y", "x"), ("y", "z"), ("z", "z2")}
    assert stuck(spark, edges) == {"x", "y", "z", "z2"}
    assert len(rounds) < 40


def test_stars_like_plain_peeling(spark, monkeypatch):
    monkeypatch.setattr(stars, "SLOW_SHARE", 2.0)
    rng = random.Random(8)
    for n in (12, 40):
        for share in (1, 2):
            edges = {(f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(n * share)}
            assert stuck(spark, edges) == peeled(edges)


def copied(columns, likes):
    found = dict(columns)
    for seq, (s, d) in sorted(likes.items()):
        for (tbl, col), first in list(found.items()):
            if tbl == s and first < seq:
                found[(d, col)] = min(found.get((d, col), seq), seq)
    return found


def run_copy(spark, columns, likes, since=None):
    cols = spark.createDataFrame([(None, "d", t, c, f) for (t, c), f in columns.items()], "scope string, db string, tbl string, col string, first_seq bigint")
    step = spark.createDataFrame([(n, n, "d", d, "d", s) for n, (s, d) in likes.items()], "stmt_id bigint, seq bigint, db string, tbl string, source_db string, source_tbl string")
    return {(r.tbl, r.col): r.first_seq for r in catalog.copy_schema_like(cols, step).collect()}


def test_copies_in_any_order(spark):
    rng = random.Random(9)
    for _ in range(4):
        columns = {(f"t{rng.randrange(6)}", f"c{rng.randrange(3)}"): rng.randrange(40) for _ in range(8)}
        likes = {n: (f"t{rng.randrange(6)}", f"t{rng.randrange(6)}") for n in rng.sample(range(40), 14)}
        assert run_copy(spark, columns, likes) == copied(columns, likes)


def test_long_chain_of_copies(spark, rounds):
    likes = {i + 1: (f"t{i}", f"t{i + 1}") for i in range(3000)}
    columns = {("t0", "a"): 0, ("t1500", "b"): 1500, ("t9", "late"): 5000}
    assert run_copy(spark, columns, likes) == copied(columns, likes)
    assert len(rounds) < 40


def walked(edges, seeds):
    found, front, hops = {}, set(seeds), 0
    while front:
        found |= dict.fromkeys(front, hops)
        front = {d for s, d in edges if s in front} - set(found)
        hops += 1
    return found


def run_reach(spark, edges, seeds, direction="down"):
    df = spark.createDataFrame(sorted(edges) + sorted(edges)[:2], "src bigint, dst bigint")
    out = graph.reach(df, spark.createDataFrame([(s,) for s in sorted(seeds)], "node bigint"), direction).collect()
    assert len(out) == len({r.node for r in out})
    return {r.node: r.hops for r in out}


def test_long_path(spark, rounds):
    edges = {(i, i + 1) for i in range(10_000)} | {(0, 20_000), (20_000, 5000), (10_000, 30_000), (10_000, 30_001), (30_001, 0)}
    assert run_reach(spark, edges, {0}) == walked(edges, {0})
    assert len(rounds) < 160


def test_chains_walk_like_single_steps(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHAINS_AFTER", 1)
    rng = random.Random(10)
    for _ in range(1):
        edges = {(i, i + 1) for i in range(40) if rng.random() < 0.95} | {(rng.randrange(41), rng.randrange(41)) for _ in range(3)} | {(50, 51), (51, 52), (52, 50), (60, 60)}
        seeds = set(rng.sample(range(41), 3)) | {50, 60, 99}
        assert run_reach(spark, edges, seeds) == walked(edges, seeds)
        assert run_reach(spark, edges, seeds, "up") == walked({(d, s) for s, d in edges}, seeds)
    columns = spark.createDataFrame([(0, "a"), (7, "b")], "node bigint, col string")
    df = spark.createDataFrame([(i, i + 1) for i in range(12)], "src bigint, dst bigint")
    got = {(r.node, r.col): r.hops for r in graph.reach(df, columns).collect()}
    assert got == {(i, "a"): i for i in range(13)} | {(i, "b"): i - 7 for i in range(7, 13)}
