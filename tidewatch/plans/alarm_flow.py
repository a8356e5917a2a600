"""From raw events to alarm transitions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.predicates import guarded_ratio
from tidewatch.operators.alarms import Alarm, alarm_states, transitions
from tidewatch.operators.metrics import fill_periods, period_start

FAILURE_RATIO = Alarm(">=", 0.5, n=2, m=2)


def failure_ratio(
    events: DataFrame, failed: Column, period: int, minimum: int, series: list[str] | None = None, ts: str = "ts"
) -> DataFrame:
    """Failures and successes per period, gaps filled with 0, and the guarded ratio.

    The raw table is read once and aggregated before its only shuffle; all
    later steps see one row per series and period.
    """
    series = series or []
    counted = events.groupBy(*series, period_start(F.col(ts), period).alias("period_start")).agg(
        F.count_if(failed).alias("failures"), F.count_if(~failed).alias("successes")
    )
    keys = series or ["scope"]
    scoped = counted if series else counted.withColumn("scope", F.lit("all"))
    filled = fill_periods(scoped, keys, period, {"failures": 0, "successes": 0})
    ratio = guarded_ratio(F.col("failures"), F.col("successes"), minimum)
    return filled.withColumn("ratio", ratio)


def failure_ratio_states(
    events: DataFrame,
    failed: Column,
    period: int = 900,
    minimum: int = 10,
    alarm: Alarm = FAILURE_RATIO,
    series: list[str] | None = None,
) -> DataFrame:
    keys = series or ["scope"]
    return alarm_states(failure_ratio(events, failed, period, minimum, series), keys, "ratio", alarm)


def failure_ratio_transitions(
    events: DataFrame,
    failed: Column,
    period: int = 900,
    minimum: int = 10,
    alarm: Alarm = FAILURE_RATIO,
    series: list[str] | None = None,
) -> DataFrame:
    keys = series or ["scope"]
    return transitions(failure_ratio_states(events, failed, period, minimum, alarm, series), keys)
