"""Script files as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwater.session import materialize

# Ranges of all files, some 100 bytes each, that are broadcast to number lines.
BROADCAST_RANGES = 200_000
_BREAK = r"(\r\n|\r|\n)"


def split_script_text(scripts: DataFrame) -> DataFrame:
    """``lines(file, line_no, line)`` of ``scripts(file, body)``.

    Line numbers come from each script's own order. A break at the very end opens no line.
    """
    body = F.regexp_replace("body", _BREAK + r"\z", "")
    cut = scripts.where("body <> ''").select("file", F.posexplode(F.split(body, _BREAK)).alias("line_no", "line"))
    return cut.withColumn("line_no", F.col("line_no").cast("bigint"))


def scan_script_lines(spark: SparkSession, paths: str | Iterable[str], root: str | None = None) -> DataFrame:
    """``lines`` of every script file under ``paths``, at any depth; ``file`` is its path below ``root``.

    A file is read in byte ranges by as many tasks as it has ranges, and no task holds more than a line. Line
    numbers take two steps: the lines of each range are counted first (the one pass that this call runs itself), then a line's number is that
    of the lines in the ranges before plus its place in its own range. A line belongs to the range it begins in; lines end at any of the three
    usual breaks, and a break at the very end opens no line.

    Without a root ``file`` is the whole path, so that scripts of one name in several folders
    stay apart. Names are as the file system has them, blanks included. A file that breaks while
    it is read stops the job; one that is listed and not there is for ``missing_scripts``.
    """
    files = spark.read.option("recursiveFileLookup", True).text(paths if isinstance(paths, str) else list(paths))
    # Rows of a range follow each other in one task, so ids count its lines; the file list fixes which task has which range.
    read = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    ranges = materialize(read.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("path", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("offset"))
    if ranges.count() <= BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    numbered = read.join(offsets, ["path", "start"])
    return numbered.select(_below(F.col("path"), root).alias("file"), (F.col("id") + F.col("offset")).alias("line_no"), "line")


def _below(path: Column, root: str | None) -> Column:
    """The decoded path, without its scheme, and without ``root`` if it begins so."""
    plus = F.regexp_replace(path, r"\+", "%2B")
    plain = F.regexp_replace(F.url_decode(plus), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    if root is None:
        return plain
    stem = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(stem)), F.substr(plain, F.lit(len(stem) + 1))).otherwise(plain)


def script_files(spark: SparkSession, paths: str | Iterable[str], root: str | None = None) -> DataFrame:
    """``(file)`` of every script that is there, empty ones too; their texts are not read.

    The names are those of the reader's own file list, which the driver holds in any case.
    """
    found = spark.read.option("recursiveFileLookup", True).text(paths if isinstance(paths, str) else list(paths)).inputFiles()
    return spark.createDataFrame([(f,) for f in found], "path string").select(_below(F.col("path"), root).alias("file"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``manifest(file, ord)``: the script names to process, in their listed order."""
    listed = scan_script_lines(spark, path)
    return listed.select(F.trim("line").alias("file"), F.col("line_no").alias("ord")).where("file <> ''")


def manifest_scripts(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Lines of the listed scripts, with each script's place in the list.

    The manifest holds one row per script and the lines side may pile up on one script;
    the join is left to the adaptive planner, which broadcasts the manifest when its
    measured size allows it and splits an oversized script otherwise.
    """
    return lines.join(manifest, "file", "inner").select("file", "ord", "line_no", "line")


def missing_scripts(lines: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed scripts that could not be read; reported, never fatal."""
    return manifest.join(lines.select("file").distinct(), "file", "left_anti")


def run_summary(statements: DataFrame) -> DataFrame:
    """Statements per script, and a total row with ``file`` null."""
    return statements.rollup("file").agg(F.count("*").alias("n_statements"))
