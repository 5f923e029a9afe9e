import numpy as np
import pytest

from headwater.llm import mixing
from headwater.llm.mixing import PULL, Rates, fit_rates, mix_documents, mixed


def brute(tokens, membership, target, rounds=20_000):
    """The same least squares, one plain projected step after another."""
    weight = tokens / tokens.sum()
    rate = np.ones(len(tokens))
    for _ in range(rounds):
        residual = ((weight * rate) @ membership - target) / target
        rate = np.maximum(0, rate - 0.05 * (membership @ residual + PULL * (rate - 1)))
    return rate


def test_rates_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLOSE", 1e-6)
    monkeypatch.setattr(mixing, "ROUNDS", 100)
    rng = np.random.default_rng(3)
    membership = rng.dirichlet([0.3] * 4, 200)
    tokens = rng.integers(1, 900, 200)
    found = spark.createDataFrame([(int(t), m.tolist()) for t, m in zip(tokens, membership)], "n_tokens bigint, membership array<double>").repartition(5)
    wish = {"a": 3.0, "b": 1.0, "c": 0.2, "d": 0.5}
    rates = fit_rates(found, wish, list("abcd"))
    target = (tokens / tokens.sum()) @ membership * np.array([3, 1, 0.2, 0.5])
    want = brute(tokens, membership, target)
    assert np.abs(rates.of(membership) - want).max() < 0.01 * want.max()
    assert want.min() >= 0


def test_kept_domains_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLOSE", 1e-6)
    monkeypatch.setattr(mixing, "ROUNDS", 200)
    rng = np.random.default_rng(7)
    membership = rng.dirichlet([0.3, 0.15], 200)
    tokens = rng.integers(1, 900, 200)
    found = spark.createDataFrame([(int(t), m.tolist()) for t, m in zip(tokens, membership)], "n_tokens bigint, membership array<double>").repartition(5)
    rates = fit_rates(found, {"a": 1.1, "b": 0.5}, list("ab"), [True, False])
    least = (membership[:, 0] >= membership[:, 1]).astype(float)
    weight, target = tokens / tokens.sum(), (tokens / tokens.sum()) @ membership * np.array([1.1, 0.5])
    want = np.ones(200)
    for _ in range(20_000):
        want = np.maximum(least, want - 0.05 * (membership @ (((weight * want) @ membership - target) / target) + PULL * (want - 1)))
    got = rates.of(membership)
    assert (got >= least).all() and np.abs(got - want).max() < 0.01 * want.max()


def test_good_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = mix_documents(docs, labels.where("doc_id % 3 != 0")).collect()
    judged_good = [r for r in got if not r.domain.endswith(":0")]
    held = [r for r in got if truth.get(r.doc_id) == 1 and r.doc_id % 3 == 0]
    low = [r for r in got if truth.get(r.doc_id) == 0]
    assert len(held) > 1000 and all(r.copies >= 1 for r in held)
    assert 0.4 < sum(r.n_tokens * r.copies for r in low) / sum(r.n_tokens for r in low) < 0.6
    assert all(r.rate >= 1 and r.copies >= 1 for r in judged_good)


def test_no_rounds_no_change():
    assert Rates(0.1).of(np.ones((3, 2))).tolist() == [1, 1, 1]


def test_odd_rows(spark):
    rows = [(i, "good words here" if i % 2 else "bad $$$ %%%", "en", "s", 3, "x") for i in range(60)]
    rows += [(None, None, None, None, None, None), (70, "", "en", "s", 0, "x"), (70, "good words " * 30_000, None, "s", 0, "x"), (70, "good words " * 30_000, None, "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, rate string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, 1, 0), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = mix_documents(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id < 60}
    assert all(by[i].domain == f"en:{i % 2}" for i in by) and by[1].rate > 1 > by[2].rate >= 0
    out = mixed(docs, labels)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} >= {i for i in range(60) if i % 2}
    assert mix_documents(docs.limit(0), labels).count() == 0
    assert all(r.rate == 1 and r.copies == 1 and r.domain is None for r in mix_documents(docs, labels.limit(0)).collect())
    assert sorted(map(str, mixed(docs, labels.limit(0)).collect())) == sorted(map(str, docs.collect()))


def test_targets_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = mix_documents(docs, labels).collect()
    membership, tokens, rate = np.array([r.membership for r in got]), np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    before, after = tokens @ membership, (tokens * rate) @ membership
    assert after.sum() == pytest.approx(before.sum(), rel=0.02)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = [r for r in got if truth.get(r.doc_id) is not None]
    assert sum(r.domain.endswith(str(truth[r.doc_id])) for r in known) >= 0.9 * len(known)
