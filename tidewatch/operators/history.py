"""Snapshots of a keyed table: drift between two and a history over many."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Rows that were added, removed or changed: ``key, status, changed_columns``."""
    columns = [c for c in declared.columns if c != key]
    d, a = declared.withColumn("_d", F.lit(True)).alias("d"), actual.withColumn("_a", F.lit(True)).alias("a")
    differs = [~F.col(f"d.`{c}`").eqNullSafe(F.col(f"a.`{c}`")) for c in columns]
    names = F.array_compact(F.array(*[F.when(t, F.lit(c)) for t, c in zip(differs, columns)]))
    joined = d.join(a, F.col(f"d.`{key}`") == F.col(f"a.`{key}`"), "full")
    status = F.when(F.col("_d").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return joined.where(F.col("_d").isNull() | F.col("_a").isNull() | reduce(or_, differs)).select(
        F.coalesce(f"d.`{key}`", f"a.`{key}`").alias(key),
        status.alias("status"),
        F.when(status == "changed", F.array_join(names, ",")).otherwise(F.lit("")).alias("changed_columns"),
    )


def apply_snapshot(history: DataFrame | None, current: DataFrame, key: str, taken: str) -> DataFrame:
    """Extend a history by one snapshot: ``valid_from, valid_to`` per version of a row.

    Open versions are compared with the snapshot in one full join; closed
    versions pass through untouched. Removed rows are closed.
    """
    columns = [c for c in current.columns if c != key]
    if history is None:
        return current.withColumn("valid_from", F.lit(taken)).withColumn("valid_to", F.lit(None).cast("string"))
    closed = history.where(F.col("valid_to").isNotNull())
    open_rows = history.where(F.col("valid_to").isNull()).withColumn("_h", F.lit(True)).alias("h")
    snapshot = current.withColumn("_c", F.lit(True)).alias("c")
    joined = open_rows.join(snapshot, F.col(f"h.`{key}`") == F.col(f"c.`{key}`"), "full")
    differs = reduce(or_, [~F.col(f"h.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in columns], F.lit(False))
    gone, new = F.col("_c").isNull(), F.col("_h").isNull()

    def version(side: str, start, end):
        return F.struct(
            F.col(f"{side}.`{key}`").alias(key),
            *[F.col(f"{side}.`{c}`").alias(c) for c in columns],
            start.alias("valid_from"),
            end.cast("string").alias("valid_to"),
        )

    kept = version("h", F.col("valid_from"), F.lit(None))
    ended = version("h", F.col("valid_from"), F.lit(taken))
    begun = version("c", F.lit(taken), F.lit(None))
    versions = (
        F.when(new, F.array(begun))
        .when(gone, F.array(ended))
        .when(differs, F.array(ended, begun))
        .otherwise(F.array(kept))
    )
    changed = joined.select(F.inline(versions))
    return closed.select(*changed.columns).unionByName(changed)
