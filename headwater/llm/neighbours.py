"""Nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long string of bits, the signs of random projections about the mean,
and keeps its strings as one sorted array, numbered by place. A query descends in every tree to its
place, where its longest-prefix matches are the rows on both sides, and reads a window of them. The
trees then go up together from the shortest prefix that all windows hold whole, which every query has
for itself: a few bits at a time a query reads the rows that a tree newly reaches, those that
differ from it in these bits, until a vector at the angle of its worst neighbour so far would have
been met in some tree with the target probability. Where the trees together would read as many rows as
there are, the query goes on to the root, which reads each row once, in one tree. There every row has been
read, so nothing is cut off. The arrays hold no vectors. Queries meet rows in blocks, and a block gives each of its
queries no more than what can be among its nearest.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import Scratch, map_batches
from headwater.llm.jaccard import groups_of
from headwater.operators.numbering import global_row_number

TREES = 16
BITS = 30
STEP = 2  # bits by which queries go up at a time; each step deals the rows of all trees once
WINDOW = 1024  # places of a sorted array that are read together; a query reads its own and the ones on both sides
TARGET_MISS = 0.05  # at most so likely is a neighbour met in no tree
BLOCK = 4096  # rows of one prefix that meet its queries at one time
QUERY_BLOCK = 1024


def clean_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vec)``: distinct rows with a key and a finite vector that is not zero, as doubles."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & good).select(F.col(key).cast("bigint").alias("id"), v.alias("vec")).distinct()


@cache
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, TREES * BITS))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _pack(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Vectors as bytes, with their length."""
    packed = [np.asarray(v, np.float64) for v in batch.column(2).to_pylist()]
    return pa.record_batch([batch.column(0), batch.column(1), pa.array([len(v) for v in packed], pa.int32()), pa.array([v.tobytes() for v in packed], pa.binary())], ["point", "ids", "dim", "raw"])


def means(points: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector by length. Tasks hand the driver one sum per length."""

    def part(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = sums.setdefault(d, [np.zeros(d), 0])
                held[0] += np.frombuffer(raw)
                held[1] += 1
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.int64())], ["dim", "sums", "n"])

    found: dict[int, list] = {}
    for r in points.select("dim", "raw").mapInArrow(part, "dim int, sums binary, n bigint").collect():
        held = found.setdefault(r.dim, [np.zeros(r.dim), 0])
        held[0] += np.frombuffer(r.sums)
        held[1] += r.n
    return {d: s / n for d, (s, n) in found.items()}


def _hasher(centres: dict[int, np.ndarray]):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        strings = []
        for d, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            signs = ((np.frombuffer(raw) - centres[d]) @ _planes(d) > 0).reshape(TREES, BITS)
            strings.append((signs @ weights).tolist())
        return pa.record_batch([batch.column(0), pa.array(strings, pa.list_(pa.int64()))], ["point", "strings"])

    return rows


def _nearest(centres: dict[int, np.ndarray], most: int):
    """For a block of rows and queries of one prefix: each query's nearest points with distance, angle about the mean and ids."""

    def block(key: tuple, part: pa.Table) -> list[tuple]:
        dim = key[0]
        asks = np.array(part.column("query").to_pylist(), bool)
        if not asks.any() or asks.all():
            return []
        points, raw, ids = part.column("point").to_numpy(), part.column("raw"), part.column("ids").to_pylist()
        vectors = _matrix(raw.combine_chunks())
        rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        about = vectors - centres[dim]
        length = np.maximum(np.linalg.norm(about, axis=1), 1e-300)
        squares = (vectors**2).sum(axis=1)
        least_ids = np.array([i[0] for i in ids])
        out = []
        for q in queries:
            rough = squares[rows] - 2 * vectors[rows] @ vectors[q] + squares[q]
            # Rounding of the short form is far below this margin; what is within it is measured exactly.
            edge = np.partition(rough, min(most, len(rows)) - 1)[min(most, len(rows)) - 1]
            close = rows[rough <= edge + 1e-9 * max(1.0, abs(edge), squares[q])]
            exact = np.sqrt(((vectors[close] - vectors[q]) ** 2).sum(axis=1))
            for k in np.lexsort((least_ids[close], exact))[:most]:
                p = close[k]
                angle = math.acos(float(np.clip(about[p] @ about[q] / (length[p] * length[q]), -1, 1)))
                out.append((int(points[q]), int(points[p]), float(exact[k]), angle, ids[p]))
        return out

    return block


def _shared_bits(a: Column, b: Column) -> Column:
    """How long a prefix two strings share."""
    return F.when(a == b, BITS).otherwise(BITS - F.length(F.bin(a.bitwiseXOR(b))))


def _outside(read: DataFrame, forest: DataFrame) -> DataFrame:
    """``(point, start)``: the length from which on every tree's window holds all rows of the query's prefix, by the rows next to the windows.

    It is ``BITS + 1`` where even the rows of the query's whole string go on beyond a window.
    """
    edges = read.select("point", "dim", "tree", "string", F.explode(F.array((F.col("block") - 1) * WINDOW - 1, (F.col("block") + 2) * WINDOW)).alias("place"))
    beside = forest.select("dim", "tree", "place", F.col("string").alias("other"))
    shared = edges.join(beside, ["dim", "tree", "place"], "left").withColumn("whole", F.coalesce(_shared_bits(F.col("string"), F.col("other")) + 1, F.lit(0)))
    return shared.groupBy("point").agg(F.max("whole").alias("start"))


def next_length(reached: int) -> int:
    """The prefix length that follows ``reached``: the next multiple of ``STEP`` below, or the root where all trees together read no fewer rows."""
    length = (reached - 1) // STEP * STEP
    return length if TREES < 1 << length else 0


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, <key>, score)``: the ``k`` nearest rows found of each row that ``is_query`` marks.

    Distances are Euclidean in double precision, ties go to the smaller key; a query is no neighbour of
    itself. Vectors that are null, empty, zero or hold a null or non-finite component, and rows with a
    null key, take no part; vectors only meet those of their length. Fewer than ``k`` rows come only where
    fewer exist. Repeated rows count once; a key with several vectors is at the distance of its nearest.
    Columns with other names are not read. An empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession)
    most = k + 1  # the query itself may be among them
    given = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = clean_vectors(given, "id", "v")
    # Equal vectors are one point; of its keys only the smallest can be among the nearest.
    order = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = rows.withColumn("nth", order).where(F.col("nth") <= most)
    grouped = firsts.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = scratch.keep(map_batches(grouped.select(F.monotonically_increasing_id().alias("point"), "ids", "vec"), _pack, "point bigint, ids array<bigint>, dim int, raw binary"), "points")
    asked = clean_vectors(given.where("query"), "id", "v").withColumnRenamed("id", "query_id")
    packed = map_batches(asked.select(F.col("query_id").alias("point"), F.array("query_id").alias("ids"), "vec"), _pack, "point bigint, ids array<bigint>, dim int, raw binary")
    # Which point each query is; equal vectors have equal bytes but for the sign of zeros.
    own = scratch.keep(packed.select(F.col("point").alias("query_id"), "raw").join(points.select("point", "raw"), "raw").select("query_id", "point"), "own")
    centres = means(points)
    strings = map_batches(points.select("point", "dim", "raw"), _hasher(centres), "point bigint, strings array<bigint>")
    grown = points.select("point", "dim").join(strings, "point").select("dim", "point", F.posexplode("strings").alias("tree", "string"))
    forest = global_row_number(grown, ["dim", "tree", "string", "point"], "place").withColumn("block", F.floor(F.col("place") / WINDOW).cast("bigint"))
    forest = scratch.keep(forest, "forest")
    bodies = points.select("point", "ids", "raw")
    schema = "asker bigint, point bigint, distance double, angle double, ids array<bigint>"

    read = scratch.keep(forest.join(own.select("point").distinct(), "point", "left_semi"), "read")
    asking = read.withColumn("block", F.explode(F.array(*(F.col("block") + i for i in (-1, 0, 1))))).withColumn("query", F.lit(True))
    window = asking.unionByName(forest.withColumn("query", F.lit(False)).join(asking.select("dim", "tree", "block").distinct(), ["dim", "tree", "block"], "left_semi"))
    found = scratch.keep(groups_of(window.join(bodies, "point"), ["dim", "tree", "block"], _nearest(centres, most), schema), "near")
    starts = scratch.keep(_outside(read, forest), "starts")

    def unsettled(level: Column) -> DataFrame:
        """Queries that have not read all rows and may miss a neighbour at the prefix length they have reached."""
        single = found.groupBy("asker", "point").agg(F.min("distance").alias("distance"), F.min("angle").alias("angle"), F.first("ids").alias("ids"))
        ranked = single.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy("distance", F.col("ids")[0]))).where(F.col("nth") <= most)
        state = ranked.groupBy(F.col("asker").alias("point")).agg(F.sum(F.size("ids")).alias("n"), F.max("angle").alias("worst")).join(starts, "point")
        miss = F.pow(1 - F.pow(1 - F.col("worst") / math.pi, level), F.lit(TREES))
        return state.where((level > 0) & ((level > BITS) | (F.col("n") < most) | (miss > TARGET_MISS))).select("point", "start")

    waiting = scratch.keep(unsettled(F.col("start")), "waiting")
    depth = BITS + 1
    while depth and (highest := waiting.agg(F.max("start")).first()[0]) is not None:
        depth = next_length(min(depth, highest))
        # Rows that share ``depth`` bits with the query and differ in the next ones; beyond the last bit, equal strings. At the root, all.
        bits = min(depth + STEP, BITS) if depth else 0
        others = range(1, 1 << (bits - depth)) if bits > depth else (0,)
        prefix = F.shiftright("string", BITS - bits)
        here = (forest if depth else forest.where("tree = 0")).withColumn("prefix", prefix)
        place = ["dim", "tree", "prefix"]
        queries = (read if depth else read.where("tree = 0")).join(waiting.where(F.col("start") > depth), "point", "left_semi")
        queries = queries.withColumn("prefix", F.explode(F.array(*(prefix.bitwiseXOR(F.lit(x).cast("bigint")) for x in others))))
        crowd = queries.groupBy(*place).agg(F.count(F.lit(1)).alias("n_queries"))
        sizes = here.join(crowd.select(*place), place, "left_semi").groupBy(*place).agg(F.count(F.lit(1)).alias("n_rows"))
        parts = crowd.join(sizes, place).select(*place, F.ceil(F.col("n_rows") / BLOCK).cast("int").alias("row_parts"), F.ceil(F.col("n_queries") / QUERY_BLOCK).cast("int").alias("query_parts"))
        parts = scratch.keep(parts, f"parts{depth}")
        if depth and parts.isEmpty():
            continue  # no tree has a row to add at this length

        def dealt(side: DataFrame, query: bool) -> DataFrame:
            """Each row goes to one part of its own side, and meets every part of the other."""
            mine, other = ("query_part", "row_part") if query else ("row_part", "query_part")
            joined = side.join(parts, place).join(bodies, "point")  # noqa: B023
            return joined.select(*place, "point", "ids", "raw", F.lit(query).alias("query"), F.pmod(F.xxhash64("point"), F.col(f"{mine}s")).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other))  # noqa: B023

        met = dealt(here, False).unionByName(dealt(queries, True))
        found = found.unionByName(scratch.keep(groups_of(met, [*place, "row_part", "query_part"], _nearest(centres, most), schema), f"near{depth}"))
        waiting = scratch.keep(unsettled(F.least("start", F.lit(depth))).join(waiting.select("point"), "point", "left_semi"), f"waiting{depth}")
    pairs = found.select("asker", F.explode("ids").alias("id"), "distance").groupBy("asker", "id").agg(F.min("distance").alias("distance"))
    kept = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy("distance", "id"))).where(F.col("nth") <= most)
    answers = own.join(kept.withColumnRenamed("asker", "point"), "point").where("id <> query_id").groupBy("query_id", "id").agg(F.min("distance").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
