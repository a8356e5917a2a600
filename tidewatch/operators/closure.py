"""Reachability over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise


def transitive_closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """All reachable pairs with their shortest distance: ``source, target, depth``.

    Each round extends only the pairs found in the round before, keeps what is
    new, and writes it out, which cuts the lineage. It ends when a round finds
    nothing, so cycles are fine and no depth is assumed.
    """
    step = materialise(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).distinct())
    found = step.withColumn("depth", F.lit(1))
    latest, depth = step, 1
    while True:
        depth += 1
        longer = latest.alias("l").join(step.alias("e"), F.col("l._t") == F.col("e._s"))
        reached = longer.select(F.col("l._s").alias("_s"), F.col("e._t").alias("_t")).distinct()
        latest = materialise(reached.join(found, ["_s", "_t"], "left_anti"))
        if latest.isEmpty():
            break
        found = found.unionByName(latest.withColumn("depth", F.lit(depth)))
    return found.select(F.col("_s").alias(source), F.col("_t").alias(target), "depth")
