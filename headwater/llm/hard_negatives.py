"""Hard negatives by inner product, with coordinate pruning in length buckets.

Rows stand in buckets by falling length, and each bucket keeps, per coordinate, its rows' unit vectors
in sorted order. An anchor with a score that has to be reached asks a bucket for the angle its rows may
have at most. A row within that angle must have, in every coordinate, a value in a range that follows
from the anchor's value there; for the anchor's largest (focus) coordinates these ranges are found in the sorted
lists and intersected, and what is left is scored exactly. A bucket whose longest row cannot reach
the score is not asked. The score to reach comes from one bucket that is searched before the others.

A bucket's rows come first in a sorted stream and its anchors after them, so a task holds one bucket,
whatever the number of anchors; a bucket gives an anchor no more rows than its answer has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, ship_package
from headwater.session import shuffle_width

BUCKET = 2048  # rows of a bucket, about
FOCUS = 6  # coordinates whose ranges are intersected
SLACK = 1e-9  # on ranges, for rounding of unit vectors; scores are whole numbers and exact


def usable_points(points: DataFrame, key: str, label: str, vector: str, anchor: Column, scale: int) -> DataFrame:
    """``(row, id, label, vec, is_anchor)`` of the rows that take part; components are floored after scaling."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = points.where(F.col(key).isNotNull() & F.col(label).isNotNull() & good)
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("double"))
    return named.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), whole.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))


class Bucket:
    """Rows of about one length, with the sorted lists of the coordinates of their unit vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        self.longest = lengths.max(initial=0.0)
        self.units = vectors / np.where(lengths, lengths, 1.0)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.units, self.order, axis=0)

    def candidates(self, vector: np.ndarray, least: float) -> np.ndarray:
        """Places of all rows whose product with the vector may be ``least`` or more."""
        every = np.arange(len(self.ids))
        length = float(np.sqrt(vector @ vector))
        if least <= 0:
            return every
        reach = length * self.longest
        if reach < least:
            return every[:0]
        apart = np.arccos(min(least / reach, 1.0))
        unit = vector / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low, high = np.cos(np.minimum(own + apart, np.pi)) - SLACK, np.cos(np.maximum(own - apart, 0)) + SLACK
        starts = [np.searchsorted(self.sorted[:, f], x) for f, x in zip(focus, low, strict=True)]
        stops = [np.searchsorted(self.sorted[:, f], x, "right") for f, x in zip(focus, high, strict=True)]
        # The shortest list is walked; a row of it has to lie in the other coordinates' ranges too.
        first = int(np.argmin(np.array(stops) - np.array(starts)))
        found = self.order[starts[first] : stops[first], focus[first]]
        for k, f in enumerate(focus):
            if k != first and len(found):
                values = self.units[found, f]
                found = found[(values >= low[k]) & (values <= high[k])]
        return found

    def scored(self, vector: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows that reach ``least``, best first, ties by id."""
        at = self.candidates(vector, least)
        scores = self.vectors[at] @ vector
        reached = scores >= least
        at, scores = at[reached], scores[reached]
        order = np.lexsort((self.ids[at], -scores))
        return at[order], scores[order]


def positives_in(bucket: Bucket, row: int, label: int, vector: np.ndarray, least: float, targets: list[int], count: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """``(0, id, score)`` of the best other rows of the anchor's label."""
    at, scores = bucket.scored(vector, least)
    fit = (bucket.labels[at] == label) & (bucket.rows[at] != row)
    return [(0, int(i), int(s)) for i, s in zip(bucket.ids[at[fit]][:count], scores[fit][:count], strict=True)]


def negatives_in(bucket: Bucket, row: int, label: int, vector: np.ndarray, least: float, targets: list[int], count: int, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """``(n, id, score)``: for the n-th positive's score the best rows of other labels that do not exceed it and have the share of it."""
    at, scores = bucket.scored(vector, least)
    fit = bucket.labels[at] != label
    ids, scores = bucket.ids[at[fit]], scores[fit].astype(np.int64)
    out = []
    for n, target in enumerate(targets):
        start = int(np.searchsorted(-scores, -target))
        near = slice(start, start + count)
        out += [(n, int(i), int(s)) for i, s in zip(ids[near], scores[near], strict=True) if share[0] * target <= share[1] * s]
    return out


def _asked(buckets: DataFrame, anchors: DataFrame, find, count: int, share: tuple[int, int], dim: int) -> DataFrame:
    """``(row, n, id, score)``: what ``find`` gives for each row of ``anchors(bucket, row, label, vec, least, targets)`` in its bucket."""
    none = lambda t: F.lit(None).cast(t)
    held = buckets.select("bucket", F.lit(0).alias("turn"), "row", "id", "label", "vec", none("double").alias("least"), none("array<bigint>").alias("targets"))
    asks = anchors.select("bucket", F.lit(1).alias("turn"), "row", none("bigint").alias("id"), "label", "vec", "least", "targets")
    stream = held.unionByName(asks).repartition(shuffle_width(buckets.sparkSession), "bucket").sortWithinPartitions("bucket", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, gathered, bucket = None, [], None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for number, turn, row, key, label, vec, least, targets in zip(*columns, strict=True):
                if number != current:
                    current, gathered, bucket = number, [], None
                vector = np.zeros(dim)
                vector[: len(vec)] = vec
                if not turn:
                    gathered.append((row, key, label, vector))
                    continue
                if bucket is None:
                    rows, ids, labels, vectors = zip(*gathered, strict=True) if gathered else ((), (), (), ())
                    bucket, gathered = Bucket(np.array(rows, np.int64), np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors).reshape(len(ids), dim)), []
                out += [(row, *found) for found in find(bucket, row, label, vector, least, targets or [], count, share)]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["row", "n", "id", "score"])

    return stream.mapInArrow(run, "row bigint, n bigint, id bigint, score bigint")


def _best(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each ``(row, n)``, best score first, ties by id, numbered from 1."""
    order = Window.partitionBy("row", "n").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine_hard_negatives(
    points: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    n_positives: int = 5, n_negatives: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A score is the inner product of components times ``scale``, floored. An anchor's positives are its best
    other rows of the same label; to each belong the best rows of other labels with a score not above the positive's
    and of at least ``share[0] / share[1]`` of it. Best first, ties by key; fewer if there are fewer; an anchor without
    positives gives no row. Rows with a null key or label, a null vector or a component that is null or not finite take no part;
    shorter vectors are as if filled with zeros. Each row is a point of its own, so repeated keys count as often as they
    stand there, as anchors too. Other columns are not read. Scores are exact while they are below 2^53.
    """
    ship_package(points.sparkSession)
    scratch = Scratch(points.sparkSession)
    usable = scratch.keep(usable_points(points, key, label, vector, anchor, scale), "points")
    size = usable.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    # Rows of one length are spread over buckets as well.
    ranged = usable.withColumn("length", length).repartitionByRange(max(1, -(-size.n // BUCKET)), F.desc("length"), F.xxhash64("row"))
    buckets = scratch.keep(ranged.withColumn("bucket", F.spark_partition_id()), "buckets")
    longest = buckets.groupBy("bucket").agg(F.max("length").alias("longest"))
    n_buckets = (longest.agg(F.max("bucket")).first()[0] or 0) + 1
    lead = buckets.agg(F.min("bucket")).first()[0] or 0
    anchors = buckets.where("is_anchor").select("row", "id", "label", "vec", "length")

    def search(of: DataFrame, find, count: int, name: str) -> DataFrame:
        """Ask the bucket of the longest rows what score has to be reached, then every bucket that can reach it."""
        tried = _asked(buckets.where(F.col("bucket") == lead), of.withColumn("bucket", F.lit(lead)), find, count, share, size.dim)
        # Only an anchor with all its answers there has a bound: the least score among them.
        full = _best(tried, count).groupBy("row", "n").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("score")).where(F.col("held") == count)
        bounds = full.groupBy("row").agg(F.count(F.lit(1)).alias("answers"), F.min("score").cast("double").alias("bound"))
        known = of.join(bounds, "row", "left")
        bound = F.when(F.col("answers") == F.greatest(F.size("targets"), F.lit(1)), F.col("bound"))
        known = known.withColumn("least", F.greatest("least", bound)).drop("answers", "bound")
        spread = known.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_buckets - 1))))
        asked = spread.join(longest, "bucket").where(F.col("least") <= F.col("longest") * F.col("length") * (1 + SLACK)).drop("longest")
        return scratch.keep(_best(_asked(buckets, asked, find, count, share, size.dim), count), name)

    no_targets = F.array().cast("array<bigint>").alias("targets")
    positives = search(anchors.select("*", F.lit(float("-inf")).alias("least"), no_targets), positives_in, n_positives, "positives")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "score", "id")))
    targets = positives.groupBy("row").agg(ranked.alias("p")).select("row", F.col("p.score").alias("targets"), F.col("p.id").alias("positives"))
    lowest = F.array_min("targets") * share[0] / share[1]
    # A negative score has no smaller share of itself that it does not exceed.
    aims = anchors.join(targets, "row").withColumn("least", F.ceil(lowest - 1e-6).cast("double"))
    negatives = search(aims, negatives_in, n_negatives, "negatives")
    named = aims.select("row", F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("positives", "targets")).alias("n", "p"))
    return (
        negatives.join(named.select("row", F.col("n").cast("bigint").alias("n"), "anchor_id", F.col("p.positives").alias("positive_id"), F.col("p.targets").alias("positive_score")), ["row", "n"])
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
