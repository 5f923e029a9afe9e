"""Help for keys that hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is split into as many parts as it has multiples of this many rows.
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, key: str, at_least: int = HOT_ROWS) -> DataFrame:
    """``(key, salts)`` for every key with ``at_least`` rows or more: the parts it is spread over."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    return hot_of(counts, key, at_least)


def hot_of(counts: DataFrame, key: str, at_least: int = HOT_ROWS) -> DataFrame:
    """The same from ``counts(key, n)``."""
    return counts.where(F.col("n") >= at_least).select(key, (F.ceil(F.col("n") / at_least) + 1).cast("int").alias("salts"))


def spread(rows: DataFrame, hot: DataFrame, key: str, by: str) -> DataFrame:
    """Give the rows of a hot key a ``salt`` from column ``by``; other rows get 0.

    Hot keys are few (each has ``HOT_ROWS`` rows); whether they are broadcast is left to their size.
    """
    salted = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64(by), F.col("salts")).cast("int")).otherwise(0)
    return rows.join(hot, key, "left").withColumn("salt", salted).drop("salts")


def replicate(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """One copy per salt for hot keys, so that every spread row finds its partner."""
    salts = F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)
    return rows.join(hot, key, "left").withColumn("salt", F.explode(salts)).drop("salts")


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, by: str, how: str = "inner", at_least: int = HOT_ROWS) -> DataFrame:
    """Join many rows to the one row per key of ``lookup``, with hot keys split over tasks.

    ``facts`` should be stored or cheap: its keys are counted first.
    """
    hot = hot_keys(facts, key, at_least)
    left, right = spread(facts, hot, key, by), replicate(lookup, hot, key)
    return left.join(right, [key, "salt"], how).drop("salt")
