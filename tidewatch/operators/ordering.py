"""Global row positions and running ranks without a single-task window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

# monotonically_increasing_id keeps the partition above this bit, the row below.
_ROW_BITS = 33


def sorted_chunks(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Range-partition by ``order``, sort inside, and fix each row's chunk and index.

    Adds ``_part`` (chunks are in order) and ``_index`` (position in the chunk).
    The result is written out: range bounds are sampled, so a recomputed
    partition could otherwise hold other rows.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    return materialise(placed).select(
        *df.columns,
        F.shiftright("_id", _ROW_BITS).cast("int").alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_index"),
    )


def with_position(df: DataFrame, order: list[str], name: str = "position", start: int = 1) -> DataFrame:
    """Number all rows in the order of ``order``, which should end in a unique column.

    Chunk sizes are one row per partition; their running sum is broadcast, so
    the rows themselves are shuffled once, by range.
    """
    chunks = sorted_chunks(df, order)
    sizes = chunks.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per shuffle partition: the only window that runs in one task.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return chunks.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_index") + start).alias(name)
    )


def running_total(df: DataFrame, group: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` from the start of each group up to and with each row.

    A group may span many chunks: their totals are added up first (at most one
    row per chunk and group), and each chunk then continues from its start.
    ``order`` should end in a column that is unique within the group.
    """
    chunks = sorted_chunks(df, [*group, *order])
    sizes = chunks.groupBy(*group, "_part").agg(F.sum(value).alias("_size"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_start"))
    left, right = chunks.alias("c"), starts.alias("s")
    same = [F.col(f"c.`{g}`").eqNullSafe(F.col(f"s.`{g}`")) for g in group]
    joined = left.join(right, reduce(and_, same, F.col("c._part") == F.col("s._part"))).select("c.*", "s._start")
    inside = Window.partitionBy(*group, "_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_start") + F.sum(value).over(inside)).drop("_part", "_index", "_start")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """The first (or last) row of each key, as an aggregate instead of a ranking.

    ``min_by`` combines before the shuffle, so a hot key sends one row per task.
    Ties end in the remaining columns, which makes the choice repeatable.
    """
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in others if c not in order])
    row = F.struct(*others)
    pick = F.max_by(row, rank) if descending else F.min_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def smallest_per_group(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """The first ``k`` values of each group's sorted list, as an array.

    The rank limit is applied in every task before the shuffle, so at most
    ``k`` rows per group and task travel, whatever the group's size.
    """
    order = Window.partitionBy(*group).orderBy(value)
    firsts = df.select(*group, value).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return firsts.groupBy(*group).agg(F.sort_array(F.collect_list(value)).alias(value))
