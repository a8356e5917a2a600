"""Starting streams and running them over what is available."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import ROCKSDB

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
# One store for both sides of a join instead of four, and no look-up before each write to count the rows.
JOIN_STATE = {
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _large_state(spark: SparkSession, wanted: bool, others: dict[str, str] | None = None):
    """Start a query with state on local disk, checkpointed to the shared folder.

    A query copies the session's settings when it starts, so the setting goes
    back to what it was right after.
    """
    settings = ({STATE_STORE: ROCKSDB} if wanted else {}) | (others or {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None):
    """Files of a folder as a stream of rows; a single file is a stream of one."""
    if path.endswith(".parquet"):
        # A pattern, because the source takes a plain path for a folder.
        path = f"{path[:-1]}[t]"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def topic_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """Records of a broker topic; needs the Kafka connector on the classpath."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .load()
    )
    return raw.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def append_available(stream: DataFrame, path: str, large_state: bool = True, name: str | None = None, join: bool = False) -> DataFrame:
    """Append the stream's rows to files below ``path``; a restart goes on from its checkpoint. ``join``: of two streams."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
    )
    if name:
        writer = writer.queryName(name)
    with _large_state(stream.sparkSession, large_state, JOIN_STATE if join and large_state else None):
        run = writer.start(path)
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def update_available(stream: DataFrame, path: str, mode: str = "update", large_state: bool = True) -> DataFrame:
    """Write each micro-batch of changed rows to its own folder, with its ``batch`` number.

    A batch that is retried overwrites its own folder, so the sink stays
    idempotent.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
    )
    with _large_state(stream.sparkSession, large_state):
        run = writer.start()
    run.awaitTermination()
    spark = stream.sparkSession
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def latest_update(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state written for each key."""
    others = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("batch")).alias("_row")).select(*keys, "_row.*")
    )


def table_available(stream: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Append the stream to a catalog table."""
    run = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(table)
    )
    run.awaitTermination()
    return stream.sparkSession.table(table)
