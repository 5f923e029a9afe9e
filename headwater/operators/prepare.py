"""From script lines to clean statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.functions import text

# Lines of one script are handled in blocks of this many line numbers, so that no task
# ever holds more than a block of one script, however large the script is.
LINE_BLOCK = 65_536


def drop_hash_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", text.drop_hash_line(F.col("line")))


def strip_dash_comments(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", text.strip_dash_comment(F.col("line")))


def erase_keywords(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", text.erase_keywords(F.col("line")))


def split_statements(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """``statements(*keys, seq, sql)``: lines joined by blanks, cut at ``;``, trimmed, never empty.

    A piece of a line belongs to statement number "semicolons before it in the script".
    That running count is made in two steps: totals per block of lines, then counts inside
    each block on top of the totals before it. Only the pieces of one statement meet in a
    group; a whole script never does.
    """
    keyed = lines.select(
        *keys,
        "line_no",
        F.expr(f"line_no div {LINE_BLOCK}").alias("block"),
        F.split("line", ";").alias("parts"),
    ).withColumn("cuts", F.size("parts") - 1)

    in_order = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before_block = (
        keyed.groupBy(*keys, "block")
        .agg(F.sum("cuts").alias("block_cuts"))
        .select(*keys, "block", F.coalesce(F.sum("block_cuts").over(in_order), F.lit(0)).alias("cuts_before"))
    )
    in_block = Window.partitionBy(*keys, "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        keyed.join(before_block, [*keys, "block"])
        .withColumn("first", F.col("cuts_before") + F.coalesce(F.sum("cuts").over(in_block), F.lit(0)))
        .select(*keys, "line_no", "first", F.posexplode("parts").alias("part", "piece"))
        .withColumn("seq", F.col("first") + F.col("part"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    joined = F.array_join(F.transform(ordered, lambda p: p["piece"]), " ")
    return (
        pieces.groupBy(*keys, "seq")
        .agg(text.trim_blanks(joined).alias("sql"))
        .where("sql <> ''")
    )


def substitute_variables(statements: DataFrame) -> DataFrame:
    return statements.withColumn("sql", text.substitute_variables(F.col("sql")))


def prepare_scripts(lines: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """The whole preparation: clean each line, cut into statements, fill in variables."""
    cleaned = lines.withColumn("line", text.clean_line(F.col("line")))
    return substitute_variables(split_statements(cleaned, keys))


def number_statements(statements: DataFrame) -> DataFrame:
    """Give ``stmt_id`` and a corpus-wide ``seq`` from script order and place in the script.

    Both are one number: script order in the high half, place in the low half. Either half
    overflowing stops the job rather than mixing up statements.
    """
    fits = (F.col("ord") < F.lit(1 << 31)) & (F.col("seq") < F.lit(1 << 32))
    statements = statements.where(F.when(fits, True).otherwise(F.raise_error(F.lit("script order or statement number out of range")).cast("boolean")))
    place = F.shiftleft(F.col("ord").cast("bigint"), 32) + F.col("seq")
    return statements.withColumn("seq", place).withColumn("stmt_id", F.col("seq"))
