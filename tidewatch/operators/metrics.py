"""Metric statistics per period and dimension, roll-ups and gap filling."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.percentile import exact_percentiles

STATISTICS = ("sum", "average", "minimum", "maximum", "sample_count")


def period_start(ts: Column, seconds: int) -> Column:
    """Epoch seconds of the period a timestamp falls in."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return (epoch - F.pmod(epoch, F.lit(seconds))).cast("bigint")


def exact_sum(value: Column, scale: int) -> Column:
    """A sum that does not depend on the order rows arrive in.

    For columns declared with ``scale`` digits only: values are added as
    decimals, and further digits would be lost.
    """
    return F.sum(value.cast(f"decimal(38,{scale})")).cast("double")


def statistic(name: str, value: Column, scale: int | None = None) -> Column:
    """An aggregate by name. Doubles are added as they are unless ``scale`` is given."""
    if name == "sum":
        return F.sum(value.cast("double")) if scale is None else exact_sum(value, scale)
    if name == "average":
        return F.avg(value.cast("double")) if scale is None else exact_sum(value, scale) / F.count(value)
    if name == "minimum":
        return F.min(value)
    if name == "maximum":
        return F.max(value)
    if name == "sample_count":
        return F.count(value)
    raise ValueError(f"{name!r} is none of {', '.join(STATISTICS)}")


def metric(
    df: DataFrame,
    period: int,
    series: list[str],
    stats: dict[str, str],
    ts: str = "ts",
    value: str = "value",
    scale: int | None = None,
) -> DataFrame:
    """One row per series and period; ``stats`` maps output names to statistics.

    Besides ``STATISTICS`` these are exact percentiles, named like ``p95`` or ``p99.9``.
    """
    keys = [*series, "period_start"]
    placed = df.withColumn("period_start", period_start(F.col(ts), period))
    fractions = {name: float(kind[1:]) / 100 for name, kind in stats.items() if re.fullmatch(r"p\d+(\.\d+)?", kind)}
    columns = [statistic(kind, F.col(value), scale).alias(name) for name, kind in stats.items() if name not in fractions]
    if not fractions:
        return placed.groupBy(*keys).agg(*columns)
    ranked = exact_percentiles(placed, keys, value, fractions)
    if not columns:
        return ranked
    others = placed.groupBy(*keys).agg(*columns).alias("o")
    same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    joined = others.join(ranked.alias("r"), reduce(and_, same), "left")
    return joined.select(*[F.col(f"o.`{k}`") for k in keys], *[F.col(f"{'r' if n in fractions else 'o'}.`{n}`") for n in stats])


def across_series(per_series: DataFrame, value: str, outer: str, name: str, keep: list[str] | None = None) -> DataFrame:
    """Combine series per period: the second level over already small rows."""
    keys = [*(keep or []), "period_start"]
    if outer not in ("sum", "maximum", "minimum"):
        raise ValueError("series are combined by sum, maximum or minimum")
    return per_series.groupBy(*keys).agg(statistic(outer, F.col(value)).alias(name))


def sum_of_components(
    df: DataFrame, period: int, component: str, components: list[str], name: str = "total", **names: str
) -> DataFrame:
    """Sum of named component series per period."""
    chosen = df.where(F.col(component).isin(components))
    per_series = metric(chosen, period, [component], {"_v": "sum"}, **names)
    return across_series(per_series, "_v", "sum", name)


def with_all_members(
    df: DataFrame, dims: list[str], stats: dict[str, tuple[str, Column]], cube: bool = False, scale: int | None = None
) -> DataFrame:
    """Roll-up (or cube) whose total rows carry ``All`` as the dimension member.

    ``stats`` maps output names to a statistic and its column. Raw rows are
    aggregated once, per finest combination of members; only those few rows are
    then multiplied into the levels. A NULL member stays NULL, and only
    grouped-away members turn into ``All``.
    """
    first, second = [], []
    for name, (kind, column) in stats.items():
        if kind not in STATISTICS:
            raise ValueError(f"{kind!r} is none of {', '.join(STATISTICS)}")
        total, count = F.col(f"_{name}_sum"), F.col(f"_{name}_n")
        if kind in ("sum", "average"):
            addend = column.cast("double" if scale is None else f"decimal(38,{scale})")
            first.append(F.sum(addend).alias(f"_{name}_sum"))
        if kind in ("average", "sample_count"):
            first.append(F.count(column).alias(f"_{name}_n"))
        if kind == "sum":
            second.append(F.sum(total).cast("double").alias(name))
        elif kind == "average":
            second.append((F.sum(total).cast("double") / F.sum(count)).alias(name))
        elif kind == "sample_count":
            second.append(F.sum(count).alias(name))
        else:
            pick = F.min if kind == "minimum" else F.max
            first.append(pick(column).alias(f"_{name}_v"))
            second.append(pick(f"_{name}_v").alias(name))
    finest = df.groupBy(*dims).agg(*first)
    grouped = finest.cube(*dims) if cube else finest.rollup(*dims)
    flags = [F.grouping(d).alias(f"_g{i}") for i, d in enumerate(dims)]
    out = grouped.agg(*second, *flags)
    members = [
        F.when(F.col(f"_g{i}") == 1, F.lit("All")).otherwise(F.col(d).cast("string")).alias(d)
        for i, d in enumerate(dims)
    ]
    return out.select(*members, *stats)


MOST_PERIODS = 10_000_000


def fill_periods(
    per_period: DataFrame,
    series: list[str],
    period: int | Column,
    fills: dict[str, object],
    first: int | Column | None = None,
    last: int | Column | None = None,
    most: int = MOST_PERIODS,
) -> DataFrame:
    """Give every series a row for each period between ``first`` and ``last``.

    The input is aggregated (at most one row per series and period). Each row
    emits itself and the missing periods up to the next one, so nothing is
    joined and no series is combined with another. Without bounds the overall
    first and last periods are used, from one scalar subquery. Columns not
    named in ``fills`` are NULL in added rows; ``filled`` tells them apart. A
    row without a time, and a gap of more than ``most`` periods (one stray
    timestamp makes one), are errors.
    """
    step = _as_column(period).cast("bigint")
    order = Window.partitionBy(*series).orderBy("period_start")
    edges = per_period.withColumn("_prev", F.lag("period_start").over(order)).withColumn(
        "_next", F.lead("period_start").over(order)
    )
    if first is None or last is None:
        extremes = per_period.agg(F.struct(F.min("period_start").alias("lo"), F.max("period_start").alias("hi")))
        edges = edges.withColumn("_bounds", extremes.scalar())
    lo = F.col("_bounds.lo") if first is None else _as_column(first)
    hi = F.col("_bounds.hi") if last is None else _as_column(last)
    own = F.col("period_start")
    start = F.when(F.col("_prev").isNull(), F.least(lo, own)).otherwise(own)
    stop = F.when(F.col("_next").isNull(), F.greatest(hi, own)).otherwise(F.col("_next") - step)
    wide = F.raise_error(F.format_string("a gap from %s to %s has more than %s periods", start, stop, F.lit(most)))
    lost = F.raise_error(F.lit("a row has no period_start"))
    periods = (
        F.when(own.isNull(), lost.cast("array<bigint>"))
        .when((stop - start) / step > most, wide.cast("array<bigint>"))
        .otherwise(F.sequence(start, stop, step))
    )
    spread = edges.withColumn("_p", F.explode(periods))
    is_own = F.col("_p") == own
    values = []
    for name in per_period.columns:
        if name in series:
            values.append(F.col(name))
        elif name == "period_start":
            values.append(F.col("_p").alias("period_start"))
        else:
            absent = F.lit(fills.get(name)).cast(per_period.schema[name].dataType)
            values.append(F.when(is_own, F.col(name)).otherwise(absent).alias(name))
    return spread.select(*values, (~is_own).alias("filled"))


def _as_column(bound: int | Column) -> Column:
    return bound if isinstance(bound, Column) else F.lit(bound).cast("bigint")


def lag_by_group(records: DataFrame, committed: DataFrame) -> DataFrame:
    """Offset and time lag per consumer group, topic and partition.

    Records shrink to one row per topic partition before the join.
    """
    heads = records.groupBy("topic", "partition").agg(
        F.max("offset").alias("head_offset"), F.max("timestamp").alias("head_ts")
    )
    return committed.join(heads, ["topic", "partition"]).select(
        "consumer_group",
        "topic",
        "partition",
        (F.col("head_offset") - F.col("committed_offset")).alias("offset_lag"),
        (F.unix_seconds("head_ts") - F.unix_seconds("committed_ts")).alias("seconds_lag"),
    )
