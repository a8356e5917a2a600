"""Alarm state, gap filling and absence detection as keyed streaming state.

All work on metric rows (one per series and period), never on raw events, so
the state and the rows of one series stay small. Periods are held back until the
watermark says that nothing earlier can come, and then taken in their order, so
results do not depend on the order of arrival. Alarms and gap filling read and
write the state of a series once a micro-batch, with its open periods in it, and
have one time-out each: a call to the state store for every period takes longer
than all the rest. Functions and processor classes are made inside functions,
which sends them to the workers by value. Absence needs ``large_state=True``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

from tidewatch.operators.alarms import Alarm
from tidewatch.operators.metrics import period_start

_TRANSITION = "series string, period_start long, previous_state string, state string"
_ABSENCE = "series string, last_seen long, deadline long"
_FILLED = "series string, period_start long, value double, filled boolean"
# What is remembered of a series, and its periods that are not final yet.
_ALARM_STATE = "last long, missed long, recent string, state string, places array<long>, breaches array<boolean>"
_FILLING_STATE = "last long, places array<long>, values array<double>"


def _timed(points: DataFrame, series: str, period: int, late: int | None, value: Column) -> DataFrame:
    """``series, period_start, value, _event_time`` with a watermark of one period unless ``late`` seconds are given."""
    delay = f"{period if late is None else late} seconds"
    start = F.col("period_start").cast("long")
    return points.select(
        F.col(series).cast("string").alias("series"),
        start.alias("period_start"),
        value,
        F.timestamp_seconds(start).alias("_event_time"),
    ).withWatermark("_event_time", delay)


def _wake(state: GroupState, due: list[int]) -> None:
    """Call the series again when the watermark reaches the earliest of these seconds, all beyond it."""
    if due:
        # A time-out comes when the watermark has passed it.
        state.setTimeoutTimestamp(max(min(due) * 1000 - 1, state.getCurrentWatermarkMs()))


def _alarm_function(n: int, m: int, period: int, missing_breaches: bool, silence: bool):
    def follow(key, rows, state: GroupState):
        """Holds periods back until they are final, then follows the state of a series through them."""
        if key[0] is None:
            return
        last, missed, recent, held, places, breaches = state.get if state.exists else (None, 0, "", "OK", [], [])
        came: dict[int, bool] = dict(zip(places, breaches))
        for batch in rows:
            for at, breach in zip(batch["period_start"].tolist(), batch["breach"].tolist()):
                came[at] = came.get(at, False) or breach
        now = state.getCurrentWatermarkMs() // 1000
        changes = []

        def step(at: int, hit: bool) -> None:
            nonlocal recent, held
            recent = (recent + ("1" if hit else "0"))[-n:]
            found = "ALARM" if recent.count("1") >= m else "OK"
            if found != held:
                changes.append((key[0], at, held, found))
                held = found

        def pass_over(upto: int) -> None:
            """Missing periods before ``upto``; after ``n`` of them the state no longer changes."""
            nonlocal missed
            while missed < n and last + (missed + 1) * period < upto:
                missed += 1
                step(last + missed * period, missing_breaches)

        for at in sorted(at for at in came if at <= now):
            if last is not None:
                pass_over(at)
            step(at, came.pop(at))
            last, missed = at, 0
        due = [min(came)] if came else []
        if silence and last is not None:
            pass_over(now + 1)
            if missed < n:
                due.append(last + (missed + 1) * period)
        state.update((last, missed, recent, held, list(came), list(came.values())))
        _wake(state, due)
        if changes:
            yield pd.DataFrame(changes, columns=["series", "period_start", "previous_state", "state"])

    return follow


def alarm_transitions(
    points: DataFrame, series: str, value: str, period: int, alarm: Alarm, late: int | None = None, silence: bool = False
) -> DataFrame:
    """State changes per series of a stream of ``series, period_start, value`` rows, in whatever order they come.

    A period is judged when the watermark, ``late`` seconds (default one period)
    behind the newest period of all series, has reached it; until then it waits
    in the state. Rows that come later still are dropped and counted by the
    stream. Missing periods follow the alarm's policy: between two points, and
    with ``silence`` also after the last one, as the watermark passes them.
    Several rows of a period count as one, which breaches if one of them does.
    Rows without a series only move the watermark. Periods beyond the watermark stay open; ``closing_point`` ends a stream.
    """
    marked = _timed(points, series, period, late, alarm.breached(F.col(value)).alias("breach"))
    follow = _alarm_function(alarm.n, alarm.m or alarm.n, period, alarm.missing == "breaching", silence)
    return marked.groupBy("series").applyInPandasWithState(follow, _TRANSITION, _ALARM_STATE, "append", "EventTimeTimeout")


def closing_point(points: DataFrame, series: str, late: int) -> DataFrame:
    """One row without a series, so late that the watermark passes every period of ``points``.

    Put at the end of a finite stream, it lets all periods become final.
    """
    after = (F.max("period_start") + F.lit(late)).alias("period_start")
    kinds = {f.name: f.dataType for f in points.schema.fields}
    last = points.agg(after)
    return last.select(*[F.col(c) if c == "period_start" else F.lit(None).cast(kinds[c]).alias(c) for c in points.columns])


def _filling_function(period: int, fill: float | None):
    def complete(key, rows, state: GroupState):
        """Puts out every period of a series once, present or not, when it is final."""
        if key[0] is None:
            return
        last, places, values = state.get if state.exists else (None, [], [])
        came = dict(zip(places, values))
        for batch in rows:
            came.update(zip(batch["period_start"].tolist(), batch["value"].tolist()))
        now = state.getCurrentWatermarkMs() // 1000
        out = []
        for at in sorted(at for at in came if at <= now):
            if last is not None:
                out += [(key[0], p, fill, True) for p in range(last + period, at, period)]
            out.append((key[0], at, came.pop(at), False))
            last = at
        due = [min(came)] if came else []
        if last is not None:
            missing = range(last + period, now + 1, period)
            out += [(key[0], p, fill, True) for p in missing]
            last += len(missing) * period
            # The next period is due even if no row comes.
            due.append(last + period)
        state.update((last, list(came), list(came.values())))
        _wake(state, due)
        if out:
            yield pd.DataFrame(out, columns=["series", "period_start", "value", "filled"])

    return complete


def filled_stream(
    points: DataFrame, series: str, value: str, period: int, fill: float | None = 0.0, late: int | None = None
) -> DataFrame:
    """Every period of every series, from its first one on: ``series, period_start, value, filled``.

    ``points`` is a stream of final metric rows, one per series and period. A
    period without a row is put out with ``fill`` once the watermark has reached
    it (see ``alarm_transitions``), without waiting for a later row of the
    series; what the watermark has not reached stays open. Rows without a series
    only move the watermark.
    """
    timed = _timed(points, series, period, late, F.col(value).cast("double").alias("value"))
    return timed.groupBy("series").applyInPandasWithState(
        _filling_function(period, fill), _FILLED, _FILLING_STATE, "append", "EventTimeTimeout"
    )


def _absence_processor(allowed: int) -> StatefulProcessor:
    class Absence(StatefulProcessor):
        """Reports a series that was silent for its allowed time, once per silence."""

        def init(self, handle):
            self.handle = handle
            self.memory = handle.getValueState("memory", "last long, reported boolean")

        def handleInputRows(self, key, rows, timerValues):
            last, reported = self.memory.get() if self.memory.exists() else (None, False)
            beats = set()
            for batch in rows:
                beats.update(batch["period_start"].unique().tolist())
            silences = []
            for beat in sorted(beats):
                if last is not None and beat <= last:
                    continue
                if last is not None and beat - last >= allowed and not reported:
                    silences.append((key[0], last, last + allowed))
                last, reported = beat, False
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not reported:
                self.handle.registerTimer((last + allowed) * 1000)
            self.memory.update((last, reported))
            yield pd.DataFrame(silences, columns=["series", "last_seen", "deadline"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last, reported = self.memory.get()
            rows = [] if reported else [(key[0], last, last + allowed)]
            self.memory.update((last, True))
            yield pd.DataFrame(rows, columns=["series", "last_seen", "deadline"])

        def close(self):
            pass

    return Absence()


def absences(beats: DataFrame, series: str, ts: str, period: int, n: int = 2, late: int | None = None) -> DataFrame:
    """Silences of at least ``n`` whole periods after a beat, also those still open.

    An open silence is reported when the watermark passes its deadline.
    """
    delay = f"{period if late is None else late} seconds"
    timed = beats.select(
        F.col(series).cast("string").alias("series"),
        F.col(ts).cast("timestamp").alias("_event_time"),
        period_start(F.col(ts), period).alias("period_start"),
    ).withWatermark("_event_time", delay)
    # One row per series and period is enough, so a busy series is thinned out
    # across all tasks before its state sees it.
    thinned = timed.dropDuplicatesWithinWatermark(["series", "period_start"])
    return thinned.groupBy("series").transformWithStateInPandas(
        statefulProcessor=_absence_processor((n + 1) * period),
        outputStructType=_ABSENCE,
        outputMode="Append",
        timeMode="EventTime",
    )
