"""Exact percentiles per group that never gather a group in one buffer or task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges of values grow by half a percent each.
_STEPS = 200
# Equal pieces that a range with a wanted rank is cut into.
_PIECES = 4096


def exact_percentiles(df: DataFrame, group: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles: one row per group, a column per fraction.

    One lazy plan at every size. Equal values are counted before the shuffle;
    counts per group and range of values locate every wanted rank, and counts
    per piece of these ranges, cut between the smallest and the largest value
    that they hold, locate it once more. Only the values of those pieces are put
    in order, each piece by itself, so neither a hot group nor one whose values
    lie close together is ordered in one task.
    """
    clean = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counted = clean.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_part", _range(F.col("_v")))
    totals = counted.groupBy(*group, "_part").agg(F.sum("_n").alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = totals.withColumn("_total", F.sum("_size").over(Window.partitionBy(*group)))
    wanted = _holding(whole, group, "_part", F.lit(0), fractions).select(*group, "_part", "_start", "_total", "_lo", "_hi")
    needed = _joined(counted, wanted, [*group, "_part"]).withColumn("_piece", _piece(F.col("_v"), F.col("_lo"), F.col("_hi")))
    place = [*group, "_part", "_start", "_total"]
    pieces = needed.groupBy(*place, "_piece").agg(F.sum("_n").alias("_size"))
    wanted = _holding(pieces.withColumnRenamed("_start", "_before"), [*group, "_part"], "_piece", F.col("_before"), fractions)
    wanted = wanted.select(*group, "_part", "_piece", F.col("_start").alias("_first"))
    inside = F.sum("_n").over(Window.partitionBy(*group, "_part", "_piece").orderBy("_v"))
    ranked = _joined(needed, wanted, [*group, "_part", "_piece"]).withColumn("_upto", F.col("_first") + inside)
    return _interpolate(ranked, group, fractions)


def _holding(sizes: DataFrame, keys: list[str], order: str, before: Column, fractions: dict[str, float]) -> DataFrame:
    """Rows of ``sizes`` (``_size``, ``_total``) that hold a wanted rank, with the rank they begin at as ``_start``."""
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_start", before + F.coalesce(F.sum("_size").over(ahead), F.lit(0)))
    holds_rank = F.lit(False)
    for fraction in fractions.values():
        for rank in _ranks(fraction):
            holds_rank = holds_rank | ((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_size")))
    return placed.where(holds_rank)


def _joined(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``wanted`` keys with its other columns."""
    same = [F.col(f"c.`{k}`").eqNullSafe(F.col(f"w.`{k}`")) for k in keys]
    others = [F.col(f"w.`{c}`") for c in wanted.columns if c not in keys]
    return rows.alias("c").join(wanted.alias("w"), reduce(and_, same)).select("c.*", *others)


def _piece(v: Column, low: Column, high: Column) -> Column:
    """Which of ``_PIECES`` equal pieces of a range a value lies in."""
    share = F.floor((v - low) / (high - low) * _PIECES)
    return F.when(low < high, F.least(share, F.lit(_PIECES - 1))).otherwise(0)


def _range(v: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.least(F.ln(F.abs(v)), F.lit(1000.0)) * _STEPS) + 1_000_000
    return F.when(F.isnan(v), 10_000_000).when(v > 0, size).when(v < 0, -size).otherwise(0)


def _ranks(fraction: float):
    exact = F.lit(fraction) * (F.col("_total") - 1)
    return F.floor(exact), F.ceil(exact)


def _interpolate(ranked: DataFrame, group: list[str], fractions: dict[str, float]) -> DataFrame:
    columns = []
    for name, fraction in fractions.items():
        low, high = _ranks(fraction)
        before = F.col("_upto") - F.col("_n")
        at_low = F.max(F.when((before <= low) & (low < F.col("_upto")), F.col("_v")))
        at_high = F.max(F.when((before <= high) & (high < F.col("_upto")), F.col("_v")))
        share = F.max(F.lit(fraction) * (F.col("_total") - 1) - low)
        # Two infinities have no difference.
        columns.append(F.when(at_low == at_high, at_low).otherwise(at_low + (at_high - at_low) * share).alias(name))
    return ranked.groupBy(*group).agg(*columns)


def approximate_percentiles(
    df: DataFrame, group: list[str], value: str, fractions: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Sketched percentiles in one mergeable pass, within ``1 / accuracy`` of the rank."""
    return df.groupBy(*group).agg(
        *[F.percentile_approx(value, f, accuracy).alias(name) for name, f in fractions.items()]
    )
