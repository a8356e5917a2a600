"""Event topics: record shape, connector options, produce and positioned reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.predicates import is_json
from tidewatch.session import source_available

# The columns of a topic record, as the Kafka connector names them.
RECORD = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"


def kafka_available(spark: SparkSession) -> bool:
    return source_available(spark, "kafka")


def producer_options(servers: str, topic: str) -> dict[str, str]:
    """At-least-once production: every replica acknowledges."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}


def consumer_options(servers: str, topic: str, offsets: dict[int, int]) -> dict[str, str]:
    """Read given partitions from given offsets; positions live in the checkpoint, not in a group."""
    import json

    positions = {topic: {str(p): o for p, o in sorted(offsets.items())}}
    return {
        "kafka.bootstrap.servers": servers,
        "assign": json.dumps({topic: sorted(offsets)}),
        "startingOffsets": json.dumps(positions),
        "failOnDataLoss": "true",
    }


def topic_name(environment: str, business: Column, app: Column, event: Column, prefix: str = "platform") -> Column:
    return F.concat_ws(".", F.lit(f"{prefix}-{environment}"), business, app, event)


def topic_parts(topic: Column) -> dict[str, Column]:
    """Environment, business, app and event of a topic name."""
    return {
        "environment": F.regexp_replace(F.split_part(topic, F.lit("."), F.lit(1)), "^[^-]*-", ""),
        "business": F.split_part(topic, F.lit("."), F.lit(2)),
        "app": F.split_part(topic, F.lit("."), F.lit(3)),
        "event": F.split_part(topic, F.lit("."), F.lit(4)),
    }


def as_records(
    df: DataFrame, key: Column, topic: Column, offset: Column, timestamp: Column, partitions: int
) -> DataFrame:
    """Rows as JSON records of a topic; the partition follows the key."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(
        key.cast("string").alias("key"),
        body.alias("value"),
        topic.alias("topic"),
        F.pmod(F.xxhash64(key.cast("string")), F.lit(partitions)).cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        timestamp.cast("timestamp").alias("timestamp"),
    )


def produce(records: DataFrame, path: str | None = None, servers: str | None = None, topic: str | None = None):
    """Send records to the broker, or to a folder of record files where there is none."""
    if servers:
        if not kafka_available(records.sparkSession):
            raise RuntimeError("sending to a broker needs the Kafka connector on the classpath")
        options = producer_options(servers, topic)
        records.select("key", "value").write.format("kafka").options(**options).save()
    else:
        records.write.mode("append").parquet(path)


def produce_stream(stream: DataFrame, servers: str, topic: str, checkpoint: str):
    """Send a stream's records to a broker; a restart may send the last batch again."""
    options = producer_options(servers, topic)
    return (
        stream.select("key", "value")
        .writeStream.format("kafka")
        .options(**options)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def read_from(spark: SparkSession, path: str, topic: str, offsets: dict[int, int | Column] | None = None) -> DataFrame:
    """Records of a topic at or after an offset per partition, a number or an expression."""
    records = spark.read.schema(RECORD).parquet(path).where(F.col("topic") == topic)
    if offsets is None:
        return records
    start = F.create_map(*[F.lit(v) for partition in sorted(offsets) for v in (partition, offsets[partition])])
    return records.where(F.col("offset") >= F.try_element_at(start, F.col("partition")))


def read_broker(spark: SparkSession, servers: str, topic: str, offsets: dict[int, int]) -> DataFrame:
    """The same from a broker, up to its newest records."""
    if not kafka_available(spark):
        raise RuntimeError("reading from a broker needs the Kafka connector on the classpath")
    raw = spark.read.format("kafka").options(**consumer_options(servers, topic, offsets)).load()
    return raw.select(
        F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
    )


def decode(records: DataFrame, schema: str) -> DataFrame:
    """Parse the JSON value into ``body``; what does not parse has ``body`` NULL.

    A record counts as decoded when it is one JSON object, whatever its fields.
    The value is parsed once, as the only member of an array, because text that
    trails an object then breaks the array. Values that hold ``],[`` could close
    that array themselves and are checked in full.
    """
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    members = F.from_json(wrapped, f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    whole = ~F.col("value").rlike(r"\]\s*,\s*\[") | is_json(F.col("value"))
    parsed = records.withColumn("_members", members)
    body = F.when((F.size("_members") == 1) & whole, F.col("_members")[0])
    return parsed.withColumn("body", body).drop("_members")
