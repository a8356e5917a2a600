"""Percentiles that can be stored and merged: one sketch per series and period.

A KLL sketch holds a bounded number of values whatever it has seen, and
sketches add up: those of periods to longer periods, those of series to all
members, without going back to the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.metrics import period_start

# The size of a sketch, and how far its ranks may be off: twice and more what one
# sketch of this size is off in 99 of 100 cases, merged or not.
SIZE = 400
RANK_ERROR = 0.02


def sketched(df: DataFrame, period: int, series: list[str], ts: str = "ts", value: str = "value", size: int = SIZE) -> DataFrame:
    """One row per series and period with ``sketch`` (binary) and ``n``, the values in it; missing values don't count.

    Sketches are built before the shuffle, so a busy series costs one sketch per task.
    """
    v = F.col(value).cast("double")
    placed = df.where(v.isNotNull()).withColumn("period_start", period_start(F.col(ts), period))
    made = placed.groupBy(*series, "period_start").agg(F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))
    return made.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def merged(sketches: DataFrame, keys: list[str | Column], size: int = SIZE) -> DataFrame:
    """Sketches added up per key, from the sketches alone."""
    added = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))
    return added.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def rolled_up(sketches: DataFrame, series: list[str], all_of: list[str], name: str = "All", size: int = SIZE) -> DataFrame:
    """The sketches and, per period, those of all members: ``name`` stands in the columns ``all_of``.

    Every set of columns is rolled up that leaves out one after the other of
    ``all_of``, from the last one on.
    """
    keys = [*series, "period_start"]
    out = sketches.select(*keys, "sketch", "n")
    for i in range(len(all_of) - 1, -1, -1):
        wide = sketches.withColumns({c: F.lit(name) for c in all_of[i:]})
        out = out.unionByName(merged(wide, keys, size).select(*keys, "sketch", "n"))
    return out


def percentiles(sketches: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """Values read off each sketch, one column per fraction in place of ``sketch``."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(f)).alias(name) for name, f in fractions.items()]
    return sketches.select(*[c for c in sketches.columns if c != "sketch"], *found)


def rank_errors(found: DataFrame, values: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """How far the ranks of ``found`` percentiles are from their fractions among ``values``: one column per fraction.

    A value covers all ranks that equal values hold; the distance to that
    stretch counts. One join with one row per key.
    """
    v = F.col(value).cast("double")
    same = [F.col(f"v.`{k}`").eqNullSafe(F.col(f"f.`{k}`")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    both = values.where(v.isNotNull()).select(*keys, v.alias("_v")).alias("v").join(found.alias("f"), condition)
    below = {name: F.avg((F.col("_v") < F.col(f"f.`{name}`")).cast("double")).alias(f"_b_{name}") for name in fractions}
    upto = {name: F.avg((F.col("_v") <= F.col(f"f.`{name}`")).cast("double")).alias(f"_u_{name}") for name in fractions}
    ranks = both.groupBy(*[F.col(f"f.`{k}`").alias(k) for k in keys]).agg(*below.values(), *upto.values())
    off = [F.greatest(F.col(f"_b_{name}") - f, F.lit(f) - F.col(f"_u_{name}"), F.lit(0.0)).alias(name) for name, f in fractions.items()]
    return ranks.select(*keys, *off)
