"""Building blocks that the script pipelines are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(amount: Column | str, precision: int = 15, scale: int = 2) -> Column:
    """Exact amount; sums of it do not depend on the order of the rows."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast(f"decimal({precision},{scale})")


def exact_sum(amount: Column | str) -> Column:
    return F.sum(money(amount)).cast("double")


def full_key_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join whose key comes from whichever side has it."""
    return left.join(right, key, "full")


def full_chain_on_first(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer joins of all tables on the first one's key alone.

    Rows that only later tables have stay apart, each under a null key. Rows with a null key match nothing;
    they are dealt by a hash of their values, or they would all meet in one task of the next join.
    """
    first, *rest = tables

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("_deal", F.when(F.col(by).isNull(), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))).otherwise(F.lit(0)))

    def attach(joined: DataFrame, nxt: DataFrame) -> DataFrame:
        left, right = dealt(joined, key), dealt(nxt.withColumnRenamed(key, "_key"), "_key").withColumnRenamed("_deal", "_dealt")
        return left.join(right, (F.col(key) == F.col("_key")) & (F.col("_deal") == F.col("_dealt")), "full").drop("_key", "_deal", "_dealt")

    return reduce(attach, rest, first)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of the one with every row of the other, for relations listed without a condition.

    The smaller side is broadcast if Spark's own estimate of its size allows it; else both sides are cut into parts that meet pairwise.
    """
    return left.crossJoin(right)


def latest_rows(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows whose ``at`` is the largest of their key.

    The maximum is found with a partial aggregate and joined back on key and value, so the
    rows of a large key are spread by value.
    """
    latest = rows.groupBy(key).agg(F.max(at).alias(at))
    return rows.join(latest, [key, at], "left_semi")


def top_then_least(rows: DataFrame, key: str, value: str, ident: str) -> DataFrame:
    """Per key the largest value and, among the rows that have it, the smallest ident.

    The smallest ident of each value comes first, so that the second step has no ties; both
    are hash aggregates on plain numbers, and a large key is spread by its values.
    """
    least = rows.groupBy(key, value).agg(F.min(ident).alias(ident))
    return least.groupBy(key).agg(F.max(value).alias("_top"), F.max_by(ident, value).alias(ident)).withColumnRenamed("_top", value)


def pivot_times(rows: DataFrame, key: str, kind: str, at: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """One pass per key: ``name -> (kind, 'min' | 'max')`` of the times of each kind of event."""
    pick = {"min": F.min, "max": F.max}
    return rows.groupBy(key).agg(*(pick[how](F.when(F.col(kind) == k, F.col(at))).alias(name) for name, (k, how) in wanted.items()))


def presence_flags(rows: DataFrame, key: str, kind: str, wanted: dict[str, str]) -> DataFrame:
    """0/1 column per kind for every key that has at least one of them."""
    some = rows.where(F.col(kind).isin(*wanted.values()))
    return some.groupBy(key).agg(*(F.max(F.when(F.col(kind) == k, 1).otherwise(0)).alias(name) for name, k in wanted.items()))


def seconds_between(later: str, earlier: str) -> Column:
    """Whole wall-clock seconds, whatever the session's time zone."""
    of_day = lambda c: F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return F.datediff(later, earlier).cast("bigint") * 86400 + of_day(later) - of_day(earlier)


def stage_delay(later: str, earlier: str) -> Column:
    """Days from one stage to the next with one decimal; 0 when they are not in order."""
    days = (seconds_between(later, earlier) / 60 / 60 / 24).cast("decimal(15,1)")
    return F.when(F.datediff(later, earlier) >= 0, days).otherwise(F.lit(0).cast("decimal(15,1)"))
