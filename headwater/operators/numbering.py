"""Row numbers over a whole table without bringing the table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headwater.session import materialize, shuffle_width


def global_row_number(rows: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Number rows 1, 2, … in the order of ``order``, whose values must tell rows apart.

    Rows are cut into ranges, sorted inside them and stored, so both passes see the same places;
    the offsets are one row per range, which bounds their broadcast. A row travels as one struct, so
    its columns may have any names; one that is called ``name`` is replaced.
    """
    kept = [c for c in rows.columns if c != name]
    width = shuffle_width(rows.sparkSession)
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    # The id holds the range above 33 bits, and below them the place in it.
    placed = materialize(ranged.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")))
    split = placed.select("row", F.shiftright("place", 33).alias("range_no"), (F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("in_range"))
    ranges = split.groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = split.join(F.broadcast(offsets), "range_no")
    number = (F.col("offset") + F.col("in_range")).cast("bigint").alias(name)
    return numbered.select(*(F.col("row").getField(c).alias(c) for c in kept), number)
