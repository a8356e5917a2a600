"""Rows that came too late, counted per query, batch and operator."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.session import literal_rows
from tidewatch.sources.metric_sink import as_datapoints, publish

NAMESPACE, METRIC = "Tidewatch/Streams", "RowsDroppedByWatermark"
_DROPPED = "query string, batch bigint, operator int, kind string, dropped bigint, at string"


class _Progress(StreamingQueryListener):
    """Keeps what each batch of each query says about its stateful operators."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.started: set[str] = set()
        self.ended: set[str] = set()
        self.changed = threading.Condition()

    def onQueryStarted(self, event):
        with self.changed:
            self.started.add(str(event.runId))

    def onQueryProgress(self, event):
        progress = event.progress
        name = progress.name or str(progress.id)
        found = [
            (name, progress.batchId, i, operator.operatorName, operator.numRowsDroppedByWatermark, progress.timestamp)
            for i, operator in enumerate(progress.stateOperators)
        ]
        with self.changed:
            self.rows += found

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()


@contextmanager
def late_rows(spark: SparkSession, path: str, seconds: float = 60):
    """Append the counts of all streams that run inside as datapoints to the metrics folder ``path``.

    One datapoint per query, batch and stateful operator, with 0 where nothing
    was dropped, so that a count that is missing shows. Progress comes from the
    stream itself and is waited for until the streams that started inside have
    ended. A retried batch reports again; ``dropped_rows`` keeps its last report.
    """
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        yield
        with progress.changed:
            if not progress.changed.wait_for(lambda: progress.started <= progress.ended, seconds):
                raise TimeoutError("a stream did not report its end")
    finally:
        spark.streams.removeListener(progress)
    if progress.rows:
        found = literal_rows(spark, progress.rows, _DROPPED)
        timed = found.withColumn("at", F.col("at").cast("timestamp"))
        dims = {name: F.col(name) for name in ("query", "batch", "operator", "kind")}
        publish(as_datapoints(timed, NAMESPACE, METRIC, F.col("dropped"), dims, F.col("at")), path)


def dropped_rows(spark: SparkSession, path: str) -> DataFrame:
    """``query, batch, operator, kind, dropped`` of every batch from the metrics folder ``path``.

    An operator that combines rows before its state, as windowed counts do,
    counts combined rows; duplicate removal and keyed processors count rows.
    """
    points = spark.read.parquet(path).where((F.col("namespace") == NAMESPACE) & (F.col("metric") == METRIC))
    of = lambda name: F.element_at("dims", F.lit(name))
    rows = points.select(
        of("query").alias("query"),
        of("batch").cast("bigint").alias("batch"),
        of("operator").cast("int").alias("operator"),
        of("kind").alias("kind"),
        F.col("value").cast("bigint").alias("dropped"),
        "ts",
    )
    keys = ["query", "batch", "operator", "kind"]
    return rows.groupBy(*keys).agg(F.max_by("dropped", "ts").alias("dropped"))
