"""Tables that a later step of a script reads back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from headwater.session import ensure_checkpoint_dir


class Stages:
    """Named tables of one run, kept in the shared folder; writing a name again replaces it."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = folder or f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid4().hex}"

    def create(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def insert(self, name: str, df: DataFrame) -> DataFrame:
        """Append by column name, as INSERT … SELECT does here."""
        df.select(*self.read(name).columns).write.mode("append").parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")
