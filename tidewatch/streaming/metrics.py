"""Windowed metrics and duplicate removal on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(
    stream: DataFrame, ts: str, period: int, series: list[str], aggregates: list[Column], late: int | None = None
) -> DataFrame:
    """Tumbling windows with a watermark of one period unless ``late`` seconds are given."""
    delay = f"{period if late is None else late} seconds"
    timed = stream.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", delay)
    out = timed.groupBy(F.window("_event_time", f"{period} seconds").alias("_w"), *series).agg(*aggregates)
    names = [c for c in out.columns if c not in ("_w", *series)]
    return out.select(*series, F.unix_seconds("_w.start").alias("period_start"), *names)


def unique_within(stream: DataFrame, ts: str, keys: list[str], seconds: int) -> DataFrame:
    """Drop redelivered records; state is kept only as long as redelivery may happen."""
    timed = stream.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark(
        "_event_time", f"{seconds} seconds"
    )
    return timed.dropDuplicatesWithinWatermark(keys).drop("_event_time")


def round_trips(
    sent: DataFrame, received: DataFrame, key: str, settle: int = 5, timeout: int = 30, late: int = 60
) -> DataFrame:
    """Sent messages with their receipt, or without one once the time bound has passed.

    Both sides have the key and ``ts``. A receipt counts from the moment of
    sending until ``settle + timeout`` seconds after it.
    """
    s = sent.select(F.col(key), F.col("ts").cast("timestamp").alias("sent_at")).withWatermark(
        "sent_at", f"{late} seconds"
    )
    r = received.select(F.col(key).alias("_key"), F.col("ts").cast("timestamp").alias("received_at")).withWatermark(
        "received_at", f"{late} seconds"
    )
    bound = F.expr(
        f"{key} = _key AND received_at >= sent_at AND received_at <= sent_at + INTERVAL {settle + timeout} SECONDS"
    )
    return s.join(r, bound, "left_outer").select(
        key,
        "sent_at",
        "received_at",
        F.when(F.col("received_at").isNotNull(), "pass").otherwise("fail").alias("status"),
    )


def batch_round_trips(sent: DataFrame, received: DataFrame, key: str, settle: int = 5, timeout: int = 30) -> DataFrame:
    """The same over finished tables; repeated receipts shrink to the earliest first."""
    s = sent.select(F.col(key), F.col("ts").cast("timestamp").alias("sent_at")).alias("s")
    r = received.select(F.col(key), F.col("ts").cast("timestamp").alias("received_at")).alias("r")
    in_time = (F.col("r.received_at") >= F.col("s.sent_at")) & (
        F.col("r.received_at") <= F.col("s.sent_at") + F.make_interval(secs=F.lit(settle + timeout))
    )
    matched = s.join(r, (F.col(f"s.{key}") == F.col(f"r.{key}")) & in_time, "left")
    return (
        matched.groupBy(F.col(f"s.{key}").alias(key), "sent_at")
        .agg(F.min("received_at").alias("received_at"))
        .withColumn("status", F.when(F.col("received_at").isNotNull(), "pass").otherwise("fail"))
    )
