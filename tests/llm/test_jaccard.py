import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from headwater.llm import jaccard
from headwater.llm.jaccard import runs_needed, shared_counts, shingle_set, similar_documents, without_near_duplicates


def brute(rows):
    """Class and links of rows (id, text) by comparing all pairs."""
    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b] or min(len(sets[a]), len(sets[b])) < 0.8 * max(len(sets[a]), len(sets[b])):
            continue
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, least.get(find(k)) if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)), key=repr)


def made(seed, families, size):
    rng = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.randrange(1, size)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(300)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def answer(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, class_id string, n bigint")
    return sorted(map(tuple, similar_documents(df).collect()), key=repr)


def test_runs():
    assert runs_needed(0.9) < runs_needed(0.9999) < 20


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert shared_counts(sets, i, j).tolist() == want and shared_counts(sets, i[:5], j[:5]).tolist() == want[:5]


def test_shingles():
    assert len(shingle_set("")) == 0 and len(shingle_set("a b")) == 1 and len(shingle_set("A b c d e f")) == 2
    assert shingle_set("a b c D e").tolist() == shingle_set("A  b\nc d e").tolist() != shingle_set("a b c d").tolist()


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (1, None), (1, ""), (2, text), (2, text), (3, text + " "), (4, "short"), (5, "short"), (6, "w " * 60_000), (2, "other words for the same key")]
    assert answer(spark, rows) == brute(rows)
    assert answer(spark, [(1, "a")]) == [(1, 1, 0)]
    assert similar_documents(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_families(spark):
    rows = made(1, 60, 8)
    assert answer(spark, rows) == brute(rows)


def test_large_buckets_split_and_fall_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    rows = made(2, 5, 60)
    assert answer(spark, rows) == brute(rows)


def test_split_gives_different_children():
    rng = np.random.default_rng(3)
    paths = rng.integers(-(2**62), 2**62, 20_000)
    tokens = np.tile(np.arange(jaccard.TOKENS, dtype=np.uint16), (len(paths), 1))
    batch = pa.record_batch([pa.array(paths), pa.array(np.arange(len(paths))), pa.array([t.tobytes() for t in tokens], pa.binary())], ["path", "rec", "tokens"])
    out = jaccard._split_paths(batch)
    rows = set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert len(rows) == out.num_rows == jaccard.FANOUT * len(paths)


def test_thousands_of_near_copies(spark):
    # Each copy has a last word of its own: 95 of 97 shingles of any two are shared, so each links with all others.
    # With these words the bucket that most pairs meet in first is one that came twice when two positions were equal.
    words = " ".join(f"w32x{i}" for i in range(99))
    df = spark.createDataFrame([(i, f"{words} e{i}") for i in range(2000)], "doc_id bigint, text string")
    got = similar_documents(df).collect()
    assert {r.n_links for r in got} == {1999} and len(got) == 2000 and {r.class_id for r in got} == {0}


def test_documents(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert sorted(map(tuple, similar_documents(documents).collect()), key=repr) == brute(rows)
    kept = without_near_duplicates(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})


def test_workers_keep_no_words_after_groups(monkeypatch):
    import pyarrow as pa

    from headwater.llm import jaccard

    class Rows:
        sparkSession = None

        def repartition(self, *keys):
            return self

        sortWithinPartitions = repartition

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(jaccard, "ship_package", lambda spark: None)
    run = jaccard.groups_of(Rows(), ["k"], lambda key, part: [(key[0], part.num_rows)], "k bigint, n bigint")
    jaccard.shingle_sets(["one two three four five six"])
    assert jaccard._word_hashes
    batches = [pa.record_batch([pa.array(k, pa.int64())], ["k"]) for k in ([1, 1, 2], [2, 2, 3])]
    assert [r for b in run(iter(batches)) for r in b.to_pylist()] == [{"k": 1, "n": 2}, {"k": 2, "n": 3}]
    assert not jaccard._word_hashes
