"""Alarm evaluation over metric rows: M of N, missing data, bands, transitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARATORS = {
    ">=": lambda v, t: v >= t,
    ">": lambda v, t: v > t,
    "<=": lambda v, t: v <= t,
    "<": lambda v, t: v < t,
}
MISSING = ("breaching", "notBreaching")


@dataclass(frozen=True)
class Alarm:
    """A threshold over a metric: breached in at least ``m`` of the last ``n`` periods."""

    comparator: str
    threshold: float
    n: int = 2
    m: int | None = None
    missing: str = "notBreaching"

    def __post_init__(self):
        if self.comparator not in COMPARATORS or self.missing not in MISSING:
            raise ValueError(f"unknown comparator or missing-data policy in {self}")
        if not 1 <= (self.m or self.n) <= self.n:
            raise ValueError("m lies between 1 and n")

    def breached(self, value: Column) -> Column:
        compared = COMPARATORS[self.comparator](value, F.lit(self.threshold))
        return F.coalesce(compared, F.lit(self.missing == "breaching"))


def alarm_states(filled: DataFrame, series: list[str], value: str, alarm: Alarm) -> DataFrame:
    """Add ``breach`` and ``state`` per period.

    The rows are one per series and period with gaps present as NULL. The first
    periods have fewer than ``n`` rows behind them and must still reach ``m``.
    """
    recent = Window.partitionBy(*series).orderBy("period_start").rowsBetween(-(alarm.n - 1), 0)
    breach = alarm.breached(F.col(value))
    marked = filled.withColumn("breach", breach)
    hits = F.sum(F.col("breach").cast("int")).over(recent)
    return marked.withColumn("state", F.when(hits >= (alarm.m or alarm.n), "ALARM").otherwise("OK"))


def transitions(states: DataFrame, series: list[str], initial: str = "OK") -> DataFrame:
    """Only the periods in which the state changes; each series starts from ``initial``."""
    order = Window.partitionBy(*series).orderBy("period_start")
    previous = F.coalesce(F.lag("state").over(order), F.lit(initial))
    return states.withColumn("previous_state", previous).where("state <> previous_state")


def anomaly_band(
    per_period: DataFrame, series: list[str], value: str, width: float = 2, history: int = 14
) -> DataFrame:
    """Trailing mean plus and minus ``width`` deviations, from earlier periods only.

    The first two periods of a series have no band and cannot breach it.
    """
    past = Window.partitionBy(*series).orderBy("period_start").rowsBetween(-history, -1)
    mean, spread = F.avg(value).over(past), F.stddev_samp(value).over(past)
    return (
        per_period.withColumn("lower", mean - width * spread)
        .withColumn("upper", mean + width * spread)
        .withColumn("breach", F.coalesce(F.col(value) > F.col("upper"), F.lit(False)))
    )


def anomaly_states(
    per_period: DataFrame, series: list[str], value: str, width: float = 2, history: int = 14, n: int = 2
) -> DataFrame:
    """Band alarm: above the upper bound in ``n`` periods in a row."""
    banded = anomaly_band(per_period, series, value, width, history)
    recent = Window.partitionBy(*series).orderBy("period_start").rowsBetween(-(n - 1), 0)
    hits = F.sum(F.col("breach").cast("int")).over(recent)
    return banded.withColumn("state", F.when(hits >= n, "ALARM").otherwise("OK"))


def heartbeat_gaps(
    beats: DataFrame, series: list[str], ts: str, period: int, n: int = 2, until: Column | None = None
) -> DataFrame:
    """Stretches of at least ``n`` whole periods without a beat.

    They lie between two beats; with an end of observation ``until`` (a time)
    also after the last one: ``next_seen`` is then NULL, and the period of the
    end itself is not counted.

    Beats shrink to one row per series and period before they are ordered, so
    a busy series costs no more than a quiet one.
    """
    from tidewatch.operators.metrics import period_start

    seen = beats.select(*series, period_start(F.col(ts), period).alias("period_start")).distinct()
    order = Window.partitionBy(*series).orderBy("period_start")
    following = F.lead("period_start").over(order)
    end = F.col("next_seen") if until is None else F.coalesce(F.col("next_seen"), period_start(until, period))
    missed = (end - F.col("period_start")) / period - 1
    return (
        seen.withColumn("next_seen", following)
        .withColumn("missed_periods", missed.cast("bigint"))
        .where(F.col("missed_periods") >= n)
        .withColumnRenamed("period_start", "last_seen")
    )


def evaluate_definitions(points: DataFrame, definitions: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Many alarms at once, each with its own statistic, period, N, M and policy.

    ``definitions`` has ``alarm, metric, statistic, period, n, m, comparator,
    threshold, missing``: several alarms may watch one metric; a NULL ``m``
    means all of ``n``. ``points`` are raw values with a metric name, a time
    and the series columns. The result has ``alarm, series, period_start,
    value, breach, state`` for every period between the first and the last
    point of all, absent ones included, for every series of the metric.

    Points shrink to one row per metric, series and period before alarms are
    joined. A breach counts when it enters the last N periods and is taken off
    when it leaves them, so one running sum serves every N.
    """
    from tidewatch.operators.metrics import fill_periods, period_start

    wanted = definitions.select("metric", "period").distinct()
    v = F.col(value).cast("double")
    shrunk = (
        points.join(wanted, "metric")
        .withColumn("period_start", period_start(F.col(ts), F.col("period")))
        .groupBy("metric", "period", *series, "period_start")
        .agg(
            F.sum(v).alias("sum"),
            F.avg(v).alias("average"),
            F.min(v).alias("minimum"),
            F.max(v).alias("maximum"),
            F.count(v).cast("double").alias("sample_count"),
        )
    )
    chosen = F.col("sum")
    for kind in ("average", "minimum", "maximum", "sample_count"):
        chosen = F.when(F.col("statistic") == kind, F.col(kind)).otherwise(chosen)
    asked = shrunk.join(definitions, ["metric", "period"]).withColumn("value", chosen)
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    seen = points.agg(F.struct(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))).scalar()
    keys = ["alarm", *series]
    asked = asked.select(*keys, "period_start", "value", "period").withColumn("_seen", seen)
    floor = lambda t: t - F.pmod(t, F.col("period"))
    first, last = floor(F.col("_seen.lo")), floor(F.col("_seen.hi"))
    filled = fill_periods(asked, [*keys, "period", "_seen"], F.col("period"), {}, first, last)
    marked = filled.select(*keys, "period_start", "value").join(definitions, "alarm")
    compared = F.lit(None).cast("boolean")
    for sign, compare in COMPARATORS.items():
        compared = F.when(F.col("comparator") == sign, compare(F.col("value"), F.col("threshold"))).otherwise(compared)
    marked = marked.withColumn("breach", F.coalesce(compared, F.col("missing") == "breaching"))
    hit = F.col("breach").cast("int")
    enters = F.struct(F.col("period_start").alias("at"), hit.alias("d"), F.lit(True).alias("own"))
    leaves = F.struct((F.col("period_start") + F.col("n") * F.col("period")).alias("at"), (-hit).alias("d"), F.lit(False).alias("own"))
    steps = marked.withColumn("_s", F.explode(F.array(enters, leaves)))
    hits = F.sum("_s.d").over(Window.partitionBy(*keys).orderBy("_s.at"))
    state = F.when(F.col("_hits") >= F.coalesce("m", "n"), "ALARM").otherwise("OK")
    return steps.withColumn("_hits", hits).where("_s.own").select(*keys, "period_start", "value", "breach", state.alias("state"))
