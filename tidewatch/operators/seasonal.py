"""An anomaly band that follows the season: hour of the day, day of the week.

Level and season are smoothed exponentially over the ordered periods of a
series. Expected is the level plus the season of the period; the band is that
plus and minus a width times the smoothed deviation. What breaches the band is
not learnt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Season:
    """How long a season is, in periods, and how fast level, season and deviation follow (0 to 1)."""

    length: int
    level: float = 0.2
    season: float = 0.3
    deviation: float = 0.2
    width: float = 2.0
    cycles: int = 2  # whole seasons that are only learnt from

    def __post_init__(self):
        if self.length < 1 or self.cycles < 1 or self.width <= 0:
            raise ValueError("a season has periods, and one is learnt from at least")
        if not all(0 < rate <= 1 for rate in (self.level, self.season, self.deviation)):
            raise ValueError("rates lie between 0 and 1")


class _Follower:
    """The state of one series: what it has learnt so far."""

    def __init__(self, season: Season, period: int):
        self.season, self.period = season, period
        self.level: float | None = None
        self.seasons = [0.0] * season.length
        self.spread = 0.0
        self.start = 0

    def step(self, at: int, value: float | None) -> tuple[float | None, float | None, bool]:
        """Lower and upper bound for a period, and whether its value is above; then learn from it."""
        s = self.season
        if self.level is None:
            if value is not None:
                self.level, self.start = value, at
            return None, None, False
        place = at // self.period % s.length
        expected = self.level + self.seasons[place]
        lower = upper = None
        if at - self.start >= s.cycles * s.length * self.period:
            margin = s.width * math.sqrt(self.spread)
            lower, upper = expected - margin, expected + margin
        if value is None:
            return lower, upper, False
        if upper is not None and value > upper:
            return lower, upper, True
        error = value - expected
        self.level = self.level + s.level * error
        self.seasons[place] = self.seasons[place] + s.season * error
        self.spread = (1.0 - s.deviation) * self.spread + s.deviation * error * error
        return lower, upper, False


def seasonal_band(per_period: DataFrame, series: list[str], value: str, period: int, season: Season) -> DataFrame:
    """``series, period_start, value, lower, upper, breach`` for every row, in the order of its series.

    Rows are one per series and period (NULL where a period is missing: it gets
    a band, breaches nothing and teaches nothing; absent rows do likewise). The
    first ``cycles`` seasons after a series' first value have no band. The place
    in the season counts from the epoch, so weeks begin on a Thursday whatever
    the series. A series runs through one task in its order, of which only the
    state is held; series are dealt out evenly.
    """
    keyed = per_period.select(*series, F.col("period_start").cast("long").alias("period_start"), F.col(value).cast("double").alias(value))
    dealt = keyed.repartition(*series).sortWithinPartitions(*series, "period_start")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema.fields)

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, follower = None, None
        for frame in frames:
            keys = list(zip(*(frame[c].where(frame[c].notna(), None) for c in series)))
            values = [None if v is None or v != v else v for v in frame[value].tolist()]
            rows = []
            for key, at, v in zip(keys, frame["period_start"].tolist(), values):
                if follower is None or key != own:
                    own, follower = key, _Follower(season, period)
                rows.append(follower.step(at, v))
            out = frame.copy()
            lower, upper, breach = zip(*rows) if rows else ((), (), ())
            out["lower"], out["upper"] = pd.array(lower, "Float64"), pd.array(upper, "Float64")
            out["breach"] = list(breach)
            yield out

    return dealt.mapInPandas(follow, f"{shape}, lower double, upper double, breach boolean")


def seasonal_states(per_period: DataFrame, series: list[str], value: str, period: int, season: Season, n: int = 2) -> DataFrame:
    """Band alarm: ``ALARM`` where the value is above the upper bound in ``n`` periods in a row."""
    recent = Window.partitionBy(*series).orderBy("period_start").rowsBetween(-(n - 1), 0)
    hits = F.sum(F.col("breach").cast("int")).over(recent)
    banded = seasonal_band(per_period, series, value, period, season)
    return banded.withColumn("state", F.when(hits >= n, "ALARM").otherwise("OK"))
