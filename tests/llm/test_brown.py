import binascii
import math
import re
from collections import Counter

import numpy as np
import pytest

from headwater.llm import brown
from headwater.llm.brown import CLASSES, exchange, likelihood, score_documents, score_held_out
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(rows, train):
    counts = Counter(w for t, ok in zip(rows, train) if ok for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    return n, [(len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for t in rows]


def check(rows, train, got):
    n, want = base(rows, train)
    assert len(got) == len(rows)
    for g, (tokens, known, score) in zip(got, want):
        assert (g.n_tokens, g.n_known, g.train_tokens) == (tokens, known, n)
        assert g.base_score == pytest.approx(score, abs=1e-6) and g.score < 0 and math.isfinite(g.score)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(1.0, (42, 42)).astype(float)
    pairs[:20, :20] *= 9
    classes = np.concatenate([rng.integers(0, CLASSES, 40), [CLASSES, CLASSES + 1]])

    def stats(c):
        after, before = np.zeros((42, CLASSES + 2)), np.zeros((42, CLASSES + 2))
        for b in range(42):
            after[:, c[b]] += pairs[:, b]
            before[:, c[b]] += pairs[b, :]
        table = np.zeros((CLASSES + 2, CLASSES + 2))
        np.add.at(table, c, after)
        return after, before, np.diagonal(pairs).copy(), table

    after, before, same, table = stats(classes)
    for w in range(40):
        moved = exchange(classes, after, before, same, np.array([w]))
        best = max(likelihood(stats(np.where(np.arange(42) == w, b, classes))[3]) for b in range(CLASSES))
        assert likelihood(stats(moved)[3]) == pytest.approx(best, abs=1e-6)


def test_probabilities_sum_to_one(spark, monkeypatch):
    rows = ["a b a c", "b a", "c c d e"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(9, w) for w in ["a", "b", "c", "d", "e", "never"]] + [(9, "")], "doc_id long, text string")
    got = score_documents(df, F.col("doc_id") < 9).where("doc_id = 9").collect()
    ends = [10**g.score for g in got if g.n_tokens == 1]
    # A word and then the end; the end's share after each word is the rest of what the word's class leaves.
    assert len(got) == 7 and 0 < ends[0] < 1 and sum(10**g.score for g in got) < 1


def test_odd_rows(spark):
    rows = ["The cat\x0bSAT", None, "", "unseen ÄÖ", "the cat " * 30_000, "the cat", "the cat"]
    train = [True, True, True, False, True, False, True]
    df = spark.createDataFrame([(i if i != 5 else None, t, ok, "x") for i, (t, ok) in enumerate(zip(rows, train))], "doc_id long, text string, ok boolean, score string")
    got = sorted(score_documents(df, F.col("ok")).collect(), key=lambda r: 5 if r.doc_id is None else r.doc_id)
    check(rows, train, got)
    assert [g.held_out for g in got] == [not t for t in train]
    assert score_documents(df.limit(0), F.col("ok")).count() == 0
    none = score_documents(df, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_unlisted_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(brown, "LISTED_WORDS", 6)
    monkeypatch.setattr(brown, "SEEDS", 3)
    monkeypatch.setattr(brown, "LEAST_COUNT", 2)
    rows = ["a a a b b b c c c d d e f g h", "a b c d q q", "h g z"]
    train = [True, True, False]
    df = spark.createDataFrame([(i, t, ok) for i, (t, ok) in enumerate(zip(rows, train))], "doc_id long, text string, ok boolean")
    got = sorted(score_documents(df, F.col("ok")).collect(), key=lambda r: r.doc_id)
    check(rows, train, got)


def brute_scores(rows, train, class_of, known_list):
    """Scores by the formulas, from token lists, given each word's class (none: rare) and which words are listed."""
    rare, end = CLASSES, CLASSES + 1
    counts = Counter(w for t, ok in zip(rows, train) if ok for w in words(t))
    kind = lambda w: end if w is None else class_of.get(w, rare)
    beyond = lambda w: w is not None and w not in known_list
    table, both = np.zeros((CLASSES + 2, CLASSES + 2)), Counter()
    second = np.zeros(CLASSES + 2)
    for t, ok in zip(rows, train):
        if ok:
            chain = [None, *words(t), None]
            for a, b in zip(chain, chain[1:]):
                if beyond(a) and beyond(b):
                    both[kind(a)] += 1
                    second[kind(b)] += 1
                else:
                    table[kind(a), kind(b)] += 1
    for a, n in both.items():
        table[a] += n * second / second.sum()
    share = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    moves = np.log10((table + brown.SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + brown.SMOOTHING))
    tokens_of = Counter()
    for w, n in counts.items():
        tokens_of[kind(w)] += n
    rare_words = sum(kind(w) == rare for w in counts)

    def emit(w):
        if w is None:
            return 0.0
        return math.log10(counts[w] / tokens_of[kind(w)]) if kind(w) < rare else math.log10((counts[w] + 1) / (tokens_of[rare] + rare_words + 1))

    return [sum(moves[kind(a), kind(b)] + emit(b) for a, b in zip(chain, chain[1:])) for chain in ([None, *words(t), None] for t in rows)]


@pytest.mark.parametrize("listed, seeds", [(200_000, 8192), (200_000, 40), (120, 40), (0, 0)])
def test_scores_by_brute_force(spark, monkeypatch, listed, seeds):
    monkeypatch.setattr(brown, "LISTED_WORDS", listed)
    monkeypatch.setattr(brown, "SEEDS", seeds)
    monkeypatch.setattr(brown, "LEAST_COUNT", 3)
    rng = np.random.default_rng(8)
    rows = [" ".join(f"w{int(x)}é" for x in rng.zipf(1.4, rng.integers(0, 60)) if x < 3000) for _ in range(150)] + ["never w1é seen never never"]
    train = [i % 7 != 2 and i < 150 for i in range(151)]
    df = spark.createDataFrame([(i, t, ok) for i, (t, ok) in enumerate(zip(rows, train))], "doc_id long, text string, ok boolean").repartition(3)
    kept = {}
    plain = brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: kept.setdefault("fit", plain(*a)))
    got = sorted(score_documents(df, F.col("ok")).collect(), key=lambda r: r.doc_id)
    check(rows, train, got)
    shared, model, dictionary = kept["fit"]
    names = shared.value[0]
    class_of = {w: int(c) for w, c in zip(names, model.kinds) if c < CLASSES}
    class_of |= {r.word: r["class"] for r in dictionary.collect() if r["class"] < CLASSES}
    counts = Counter(w for t, ok in zip(rows, train) if ok for w in words(t))
    assert set(class_of) == {w for w, n in counts.items() if n >= 3}, "every word above the least count has a class"
    assert len(names) <= listed and (listed == 200_000 or len(names) < len(counts))
    want = brute_scores(rows, train, class_of, set(names))
    assert [g.score for g in got] == pytest.approx(want, abs=1e-6)


def test_placed_where_likelihood_rises_most(spark):
    rng = np.random.default_rng(6)
    table = rng.poisson(40.0, (brown.WIDTH, brown.WIDTH)).astype(float)
    sums = rng.poisson(2.0, (12, 2 * brown.WIDTH))
    rows = [(w, s, int(n)) for w, r in enumerate(sums) for s, n in enumerate(r) if n]
    got = {r.word: r["class"] for r in brown.placed(spark.createDataFrame(rows, "word long, slot int, n long"), table).collect()}

    for w in range(12):
        def gain(b):
            out = 0.0
            for side, own in ((table[b], sums[w, : brown.WIDTH]), (table[:, b], sums[w, brown.WIDTH :])):
                f = lambda x: float((np.asarray(x, float) * np.log(np.maximum(x, 1))).sum())
                out += f(side + own) - f(side) - f(side.sum() + own.sum()) + f(side.sum())
            return out

        assert gain(got[w]) == pytest.approx(max(gain(b) for b in range(CLASSES)))


def test_codes_are_those_of_spark(spark):
    names = ["a", "é", "", "w" * 100, "\U0001F600"]
    got = spark.createDataFrame([(w,) for w in names], "w string").select(brown.code_of(F.col("w"))).collect()
    assert [r[0] for r in got] == [brown.word_code(w.encode()) for w in names]


def test_documents(spark, documents):
    given = sorted(documents.collect(), key=lambda r: r.doc_id)
    train = [binascii.crc32(str(r.doc_id).encode()) % 7 != 2 for r in given]
    got = sorted(score_held_out(documents).collect(), key=lambda r: r.doc_id)
    check([r.text for r in given], train, got)
    held = [g for g in got if g.held_out]
    assert [g.held_out for g in got] == [not t for t in train]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_texts_are_numbered_as_one_row():
    words, ids, ends = brown.numbered(["b a\n", "", "A z"], {b"a": 0, b"b": 1}.get, 2, 3)
    assert words == [None, b"b", b"a", None, None, b"a", b"z", None]
    assert ids.tolist() == [3, 1, 0, 3, 3, 0, 2, 3]
    assert ends == [0, 3, 4, 7]
