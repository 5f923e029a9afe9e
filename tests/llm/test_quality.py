import random

import numpy as np
import pytest

from headwater.llm import quality
from headwater.llm.queries import ORACLES, QUERIES
from tests.llm.twins import same_as_twin


def brute(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)})


def test_repeat_words():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(40))]
        assert quality.measure(" ".join(words))[-1] == brute(words)
    many = np.arange(40_000)
    assert quality.repeat_words(np.r_[many, many[:6]], 40_000) == 12


def test_counts():
    assert quality.measure("ab  cé\n\nab x #*\n#*\n#*\n \t") == (7 - 1, 4 + 4 + 2 * 3 - 0, 6, 4, 1, 0)


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (2, "", "en", None, "x"), (2, "", "en", None, "x"), (None, "one " * 5000, None, "s", "x"), (4, "a b c d e f g h i j k", "en", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept string")
    got = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judge_quality(df).collect()), key=repr)
    assert got == sorted([(1, 0, True, False), (2, 0, True, False), (2, 0, True, False), (None, 5000, True, False), (4, 11, False, True)], key=repr)
    assert quality.judge_quality(df.limit(0)).count() == 0


def test_fences_differ_between_groups_and_decide(spark):
    """On sf0.1: the fences of every metric follow the group, and symbols, repeats and word lengths drop rows that the base rule passes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    measured = quality.with_metrics(quality.document_counts(docs, "doc_id", "text", "lang", "source")).cache()
    limits = quality.group_fences(quality.sketches(measured)).cache()
    n = limits.agg(*(quality.F.count_distinct(f"fence.{m}_high").alias(m) for m in quality.METRICS)).first()
    assert all(n[m] > 1 for m in quality.METRICS), n
    passing = measured.where(f"NOT ({quality.BASE_FAILED})").join(limits, quality.F.col("lang").eqNullSafe(quality.F.col("f_lang")) & quality.F.col("source").eqNullSafe(quality.F.col("f_source")))
    dropped = passing.agg(*(quality.F.count(quality.F.when(quality.F.expr(f"NOT {m} BETWEEN fence.{m}_low AND fence.{m}_high"), 1)).alias(m) for m in quality.METRICS)).first()
    assert dropped.symbols and dropped.repeats and dropped.word_length, dropped
    print(n, dropped)


def test_values_that_agree(spark):
    """A group whose values are all alike, as copies make them, lets others pass up to a multiple of it."""
    rows = [(i, " ".join(["# one two three four five six seven eight nine"] + [f"w{i}x{j}" for j in range(40)]), "en", "s") for i in range(40)]
    rows += [(100, rows[0][1] + " # #", "en", "s"), (101, rows[0][1] + " #" * 4 + " a" * 3 + " #" * 30, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge_quality(df).collect()}
    assert all(got[i] for i in range(40)) and got[100] and not got[101]


def test_sketch_buckets(spark):
    got = spark.range(0, 5000).select("id", quality.bucket(quality.F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id <= r.b * 33 / 32 or r.b == r.id for r in got)
    assert [r.b for r in got] == sorted(r.b for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_twin(spark, sf):
    same_as_twin(spark, QUERIES["op8_quality_rules"], ORACLES["op8_quality_rules"], sf)
