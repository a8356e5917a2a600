"""One stream of records fanned out into one catalog table per event."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.schema import struct_type
from tidewatch.session import existing, make_folder
from tidewatch.sources.catalog import quoted, register_external, text_literal

BATCH = "_batch"
UNROUTED = "_unrouted"


class Router:
    """Tables of the declared events below one folder, one partition per micro-batch.

    All tables of a batch are written by one job: rows are laid out by event and
    batch number, and each table is registered over its own event's folder. A
    batch that is retried replaces its own partitions and doubles nothing. Rows
    of events that are not declared go to the table ``UNROUTED`` with their
    event's name; none are lost.
    """

    def __init__(self, spark: SparkSession, database: str, path: str, columns: list[dict], events: list[str]):
        self.spark, self.database, self.path = spark, database, path.rstrip("/")
        self.columns, self.events = columns, sorted(set(events))
        wrong = [e for e in self.events if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", e)]
        if wrong:
            raise ValueError(f"not names of events: {wrong}")
        names = [self.table(e) for e in self.events]
        if len(set(names)) != len(names):
            raise ValueError("two events have the same table name")

    def table(self, event: str) -> str:
        """Its table; events are named in letters, digits, hyphens, dots and underscores."""
        name = event.lower().replace("-", "_").replace(".", "_")
        return f"{self.database}.{name}"

    def _location(self, event: str) -> str:
        return f"{self.path}/_event={event}"

    def create(self) -> Router:
        """Register every table, empty until rows come; a second call changes nothing."""
        batch = [{"name": BATCH, "type": "bigint"}]
        for event in [*self.events, UNROUTED]:
            own = [{"name": "event", "type": "string"}] if event == UNROUTED else []
            make_folder(self.spark, self._location(event))
            register_external(self.spark, self.table(event), "parquet", self._location(event), [*self.columns, *own, *batch], [BATCH])
        return self

    def write(self, rows: DataFrame, event: Column, number: int) -> None:
        """Write one micro-batch; the same rows under the same number again replace what it wrote before."""
        declared = event.isin(self.events)
        fields = struct_type(self.columns).fields
        shaped = rows.select(
            *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields],
            F.when(~F.coalesce(declared, F.lit(False)), event).alias("event"),
            F.when(declared, event).otherwise(F.lit(UNROUTED)).alias("_event"),
            F.lit(number).cast("bigint").alias(BATCH),
        )
        # A rebalance splits a large event over several files and joins small pieces.
        writer = shaped.hint("rebalance", "_event").write.partitionBy("_event", BATCH).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for location in existing(self.spark, f"{self.path}/_event=*/{BATCH}={number}"):
            name = location.split("/_event=")[1].split("/")[0]
            self.spark.sql(
                f"ALTER TABLE {quoted(self.table(name))} ADD IF NOT EXISTS PARTITION ({BATCH} = {number}) LOCATION {text_literal(location)}"
            )

    def run_available(self, stream: DataFrame, event: Column, checkpoint: str) -> None:
        """Route what is available; a restart goes on from the checkpoint, with the batch it stopped in."""
        self.create()
        query = (
            stream.writeStream.foreachBatch(lambda batch, number: self.write(batch, event, number))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def rows(self, event: str) -> DataFrame:
        return self.spark.table(self.table(event))
