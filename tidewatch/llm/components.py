"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Each round connects the larger neighbours of every node to its smallest
    neighbour, then the smaller ones, until nothing changes: about the
    logarithm of the longest path in rounds. Neighbourhoods are only ever
    aggregated to a minimum and joined back, so a node with very many links is
    no group that a task must hold. Rounds are cut by written tables.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Larger neighbours of u go to the smallest of u's neighbourhood.
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Then u and its smaller neighbours go to the smallest of these.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        after = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v")))
        after = materialise(after.where("u <> v").distinct())
        # Stars only: no node points to two others, none that is pointed to points on.
        changed = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        edges = after
        if changed:
            break
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(member.select(F.col("component").alias("node"), "component").distinct())
