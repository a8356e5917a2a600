"""Members of groups, one row each: a list of any length without an array."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children_per_parent(df: DataFrame, parents: list[str], child: str, having: int = 1) -> DataFrame:
    """``(parents, child, n_rows)``: every distinct child of every parent.

    The shape is the same at any size: a hot parent is many rows, spread by its
    children. NULL is one more parent and one more child. ``having`` keeps the
    parents of at least that many rows; their counts come from the counted
    pairs, so the input is read once.
    """
    pairs = df.groupBy(*parents, child).agg(F.count(F.lit(1)).alias("n_rows"))
    if having <= 1:
        return pairs
    large = children_counts(pairs, parents).where(F.col("n_rows") >= having)
    same = [F.col(f"a.`{p}`").eqNullSafe(F.col(f"b.`{p}`")) for p in parents]
    return pairs.alias("a").join(large.alias("b"), reduce(and_, same), "left_semi")


def children_counts(pairs: DataFrame, parents: list[str]) -> DataFrame:
    """``(parents, n_rows, n_children)`` of the result of ``children_per_parent``."""
    return pairs.groupBy(*parents).agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_children"))
