import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from headwater.llm import hard_negatives
from headwater.llm.hard_negatives import Bucket, mine_hard_negatives
from headwater.llm.queries import QUERIES


def brute(rows, anchors, low=80, high=100):
    points = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            points.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for n, (i, label, v) in enumerate(points):
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for m, (j, other, w) in enumerate(points) if m != n)
        for score, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [x for x in scored if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score][:5]
            out += [(i, j, r + 1, k, -score, -s) for r, (s, k, _) in enumerate(fit)]
    return sorted(out)


def points(rng, n, dim):
    rows = [(i, (rng.normal(size=dim) * rng.choice([0.2, 1.0, 3.0])).tolist(), int(rng.integers(4))) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim, int(i % 3)) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.5, None], 1), (2002, [float("nan")] * dim, 1), (2003, [float("inf")] * dim, 1), (2004, [0.0] * dim, 1), (2005, [], 2), (2006, [1.0], 2)]
    return rows + [(None, [0.5] * dim, 1), (2010, [0.5] * dim, None), rows[5], rows[5]]


def same(spark, rows, monkeypatch, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, row int, bucket string")
    got = sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    want = brute(rows, lambda i: i % 5 == 0)
    assert got == want and len(want) > 100
    assert mine_hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


@pytest.mark.parametrize("bucket", [24, 4096])
def test_against_brute_force(spark, monkeypatch, bucket):
    rng = np.random.default_rng(bucket)
    same(spark, points(rng, 120, 6), monkeypatch, bucket)


def test_ranges_leave_nothing_out():
    rng = np.random.default_rng(4)
    pruned = 0
    for dim in (1, 2, 5, 16):
        vectors = np.floor(rng.normal(size=(300, dim)) * rng.choice([5, 50, 60], size=(300, 1)))
        vectors[:5] = 0
        bucket = Bucket(np.arange(300), np.arange(300), np.zeros(300, np.int64), vectors)
        for v in np.floor(rng.normal(size=(40, dim)) * 50):
            scores = vectors @ v
            for least in (-5.0, 0.0, 1.0, *np.quantile(scores, [0.5, 0.9, 0.99, 1.0]), scores.max() + 1):
                found = set(bucket.candidates(v, least).tolist())
                assert {i for i in range(300) if scores[i] >= least} <= found
                pruned += least > 0 and len(found) < 150
    assert pruned > 200


def test_anchors_without_answers(spark):
    rows = [(0, [1.0], 1), (1, [1.0], 2), (5, [-1.0], 3), (6, [1.0], 3), (10, [0.0], 4), (11, [1.0], 4)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, mine_hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))
    assert got == brute(rows, lambda i: i % 5 == 0)


def test_query_changes_the_labels_first(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label if r.vec_id % 7 or r.label is None else (r.label + 1) % 10) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, folder).collect())) == brute(rows, lambda i: i % 100 == 0)
