import math

import numpy as np
from pyspark.sql import functions as F

from headwater.llm import neighbours
from headwater.llm.neighbours import nearest_neighbours


def brute(rows, queries, k=10):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q in sorted({i for i, _ in good if queries(i)}):
        best = {}
        for qi, qv in good:
            if qi == q:
                for i, v in good:
                    if i != q and len(v) == len(qv):
                        best[i] = min(best.get(i, math.inf), math.dist(v, qv))
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:k])]
    return out


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12, atol=1e-12)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 130)] + [(7, [0.5, 0.5, 0.5, 0.5]), (3, rows[3][1])]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (210, [1.0, 2.0]), (211, [1.0, 5.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    same(got, brute(rows, lambda i: i % 5 == 0))
    assert nearest_neighbours(df.limit(0), F.lit(True)).count() == 0


def test_recall_below_the_root(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 4)
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    assert len(got) == len(want)
    found = {g[:1] + g[2:3] for g in got}
    assert sum((w[0], w[2]) in found for w in want) >= 0.9 * len(want)


def test_windows_full_of_equal_strings(spark, monkeypatch):
    # Points on one ray about the mean have one string in every tree, so no window holds its prefix whole.
    monkeypatch.setattr(neighbours, "WINDOW", 2)
    rows = [(i, [1.0 + i, 2.0 + 2 * i]) for i in range(30)] + [(100 + i, [-1.0 - i, -2.0 - 2 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()]
    same(got, brute(rows, lambda i: i % 10 == 0))


def test_few_lengths_then_the_root(spark, monkeypatch):
    # Where all trees together would read as many rows as there are, each row is read once instead, and nothing is missed.
    monkeypatch.setattr(neighbours, "WINDOW", 4)
    kept, keep = [], neighbours.Scratch.keep
    monkeypatch.setattr(neighbours.Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    same(got, brute(rows, lambda i: i % 100 == 0))
    lengths = [int(n[4:]) for n in kept if n.startswith("near") and n != "near"]
    assert lengths[-1] == 0 and all(d > 4 and d % 2 == 0 for d in lengths[:-1])
