"""What the operators share: tables, stored intermediate results, Arrow batches in and out."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headwater.session import ensure_checkpoint_dir, ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Written tables of one run in the shared checkpoint folder; gone when the session's JVM ends.

    A stored table survives lost executors, and what reads it twice does not compute it twice.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid4().hex}"
        self._fs().deleteOnExit(self._path(self.folder))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        """Remove a stored table that no later plan reads."""
        self._fs().delete(self._path(f"{self.folder}/{name}"), True)


def fold_is(key: Column, modulus: int, rest: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``, equals ``rest``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == rest, F.lit(False))


# Rows of texts that are Python objects at one time in a worker.
ROWS_AT_ONCE = 1000


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Run ``fn`` on slices of each Arrow batch; what it returns must have the columns of ``schema``."""

    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = fn(batch.slice(start, ROWS_AT_ONCE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``limit`` bytes of one string column, or of one row that is larger."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


# Arrow batches are cut by bytes too, so that a batch of long texts takes no more room than one of short ones.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def bound_batches(spark: SparkSession) -> None:
    """Cut the session's Arrow batches by rows and bytes, where they are not cut smaller already."""
    for name, most in _LIMITS.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


# What operators keep in a worker between tasks, by module.
_KEPT = {"headwater.llm.jaccard": "_word_hashes", "headwater.llm.pieces": "_compiled"}


def forget_others(own: str = "") -> None:
    """Empty what other operators have kept in this worker, which Spark uses for one stage after the other."""
    for module, name in _KEPT.items():
        if module != own and module in sys.modules:
            getattr(sys.modules[module], name).clear()
    pa.default_memory_pool().release_unused()


def with_columns_of(docs: DataFrame, text: str, fn: Callable[[list[str]], list[pa.Array]], added: str) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and the columns of ``added`` that ``fn`` gives for the texts.

    Each text goes over once, as a field of its row; columns may have any names.
    """
    row = docs.select(F.struct("*").alias("row"))
    place = docs.columns.index(text)
    names = ["row", *(c.split()[0] for c in added.split(", "))]
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            for part in (batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)):
                yield pa.record_batch([part.column(0), *fn(texts_of(part.column(0).field(place)))], names)

    return row.mapInArrow(run, StructType([*row.schema.fields, *StructType.fromDDL(added).fields]))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``row`` holds."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))
