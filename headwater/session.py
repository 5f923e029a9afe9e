"""Session settings and lineage-cutting storage."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Read by every job below; a cluster deployment overrides them at submit time.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# A stored graph layout has about this many rows per part.
ROWS_PER_PART = 250_000


def build_session(app: str = "headwater", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``master`` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local master.

    Checkpoints outlive an executor only if every executor can read them, so a
    machine-local folder is refused anywhere but in one-process local mode, where it goes with
    the process.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif re.fullmatch(r"local(\[.*\])?", sc.master):
        folder = tempfile.mkdtemp(prefix="headwater-ckpt-")
        sc.setCheckpointDir(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store reliably, and cut the plan there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_layout(df: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Store ``df`` in a layout that later plans still know; also its row count.

    Adaptive execution hides the partitioning of what it ran and picks its own number of
    parts, so it is off for this one write and shuffles make ``width`` parts. The rows are
    counted on the stored copy: an empty plan may be folded away before it runs.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(width)}
    before = {key: spark.conf.get(key) for key in fixed}
    try:
        for key, value in fixed.items():
            spark.conf.set(key, value)
        stored = df.checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return stored, stored.count()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts for a stored layout of this many rows: no more than the session shuffles into."""
    return max(1, min(shuffle_width(spark), -(-rows // ROWS_PER_PART)))


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, which the driver may have from a path that they do not know. Once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_headwater_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="headwater-")) / f"{root.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as package:
        for file in sorted(root.rglob("*.py")):
            package.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(name))
    sc._headwater_shipped = True
