"""Long chains in a number of rounds that grows with the logarithm of their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.session import materialize


def chain_ends(pointers: DataFrame) -> DataFrame:
    """``(node, end, steps)`` of ``pointers(node, to)``, at most one per node: the last node on the way and how far it is.

    ``end`` is null if the way never ends. Every round lets each node point where its target points, so ways double in
    length; after as many rounds as the logarithm of the number of nodes, what still has a target with a pointer goes
    round a cycle. A round moves one row per node.
    """
    at = materialize(pointers.select("node", "to", F.lit(1).cast("bigint").alias("steps")))
    for _ in range(max(1, at.count()).bit_length() + 1):
        beyond = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        far = materialize(at.join(beyond, "to", "left"))
        moving = not far.where("next IS NOT NULL").isEmpty()
        at = far.select("node", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        if not moving:
            return at.select("node", F.col("to").alias("end"), "steps")
    starts = at.select(F.col("node").alias("to"), F.lit(True).alias("goes_on")).distinct()
    return at.join(starts, "to", "left").select("node", F.when(F.col("goes_on").isNull(), F.col("to")).alias("end"), "steps")


def spread_down(found: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct ``(node, load)``: ``found(node, load)`` and what follows from it along ``steps(node, before)``, to any depth.

    Shortcuts over 1, 2, 4, … steps are made by joining the last ones with themselves, and each length is walked once,
    from all that was found so far. Steps must have no cycle. Where a node has one step before it, as in a forest, there are
    never more shortcuts than steps.
    """
    found = materialize(found.select("node", "load").distinct())
    steps = materialize(steps.select("node", "before").distinct())
    while not steps.isEmpty():
        more = found.select(F.col("node").alias("before"), "load").join(steps, "before").select("node", "load")
        found = materialize(found.unionByName(more).distinct())
        twice = steps.select(F.col("node").alias("mid"), F.col("before").alias("first")).join(steps.select("node", F.col("before").alias("mid")), "mid")
        steps = materialize(twice.select("node", F.col("first").alias("before")).distinct())
    return found
