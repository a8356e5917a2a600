"""Landed files: one writer and one reader per format, run-scoped paths, cleanup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.schema import apply_schema, struct_type
from tidewatch.session import source_available

FORMATS = ("csv", "json", "avro", "parquet")

# NTZ timestamps keep their microseconds in text formats.
_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
_TEXT_OPTIONS = {"timestampNTZFormat": _MICROS, "timestampFormat": _MICROS}
_OPTIONS = {
    "csv": {"header": "true", "sep": ",", "escape": '"', "multiLine": "false", **_TEXT_OPTIONS},
    "json": _TEXT_OPTIONS,
    "avro": {},
    "parquet": {},
}


class UnknownFormat(ValueError):
    pass


class FormatUnavailable(RuntimeError):
    """The format's data source is not on this cluster's classpath."""


def avro_available(spark: SparkSession) -> bool:
    return source_available(spark, "avro")


def check_format(spark: SparkSession, fmt: str) -> str:
    name = fmt.lower()
    if name not in FORMATS:
        raise UnknownFormat(f"{fmt!r} is none of {', '.join(FORMATS)}")
    if name == "avro" and not avro_available(spark):
        raise FormatUnavailable("avro needs the spark-avro module on the classpath")
    return name


# Files that a task writes side by side before it sorts what is left by key.
OPEN_FILES = 16
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_files(df: DataFrame, path: str, fmt: str, partition_by: list[str] | None = None, mode: str = "append"):
    """Write one dataset. Partitioned output is rebalanced first, so every key's
    rows arrive together, small partitions share a task and a hot key is split.
    A task needs no sort, which would hold all its rows, unless it has many keys."""
    name = check_format(df.sparkSession, fmt)
    if partition_by:
        missing = [k for k in partition_by if k not in df.columns]
        if missing:
            raise ValueError(f"partition keys are not among the columns: {', '.join(missing)}")
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode(mode).format(name).options(**_OPTIONS[name])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(_WRITERS)
    conf.set(_WRITERS, max(int(before), OPEN_FILES))
    try:
        writer.save(path)
    finally:
        conf.set(_WRITERS, before)


def read_files(spark: SparkSession, path: str, fmt: str, columns: list[dict]) -> DataFrame:
    """Read with the declared columns; nothing is inferred from text.

    CSV booleans are read as text, because the truth set includes ``1``.
    Self-describing files are read with their own schema and cast after.
    """
    name = check_format(spark, fmt)
    reader = spark.read.format(name).options(**_OPTIONS[name])
    if name in ("csv", "json"):
        declared = struct_type(columns)
        if name == "csv":
            declared = T.StructType(
                [
                    T.StructField(f.name, T.StringType() if f.dataType == T.BooleanType() else f.dataType)
                    for f in declared.fields
                ]
            )
        return apply_schema(reader.schema(declared).load(path), columns)
    return apply_schema(reader.load(path), columns)


def landing_path(base: str, namespace: str, name: str, run_id: str | None = None) -> str:
    root = f"{base.rstrip('/')}/{namespace}/{name}"
    return f"{root}/run_id={run_id}" if run_id else root


def land(df: DataFrame, base: str, namespace: str, name: str, run_id: str, fmt: str) -> str:
    """Write one run below ``<base>/<namespace>/<name>/run_id=<run>``.

    A retried landing overwrites its own run, never another.
    """
    path = landing_path(base, namespace, name, run_id)
    write_files(df, path, fmt, mode="overwrite")
    return path


def with_provenance(df: DataFrame) -> DataFrame:
    """Add the file a row came from."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"))


def remove_paths(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Delete landed runs one by one; a failure is recorded and the rest go on."""
    outcomes = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = hadoop.Path(path)
        try:
            done = target.getFileSystem(conf).delete(target, True)
            outcomes.append({"path": path, "ok": bool(done), "error": None if done else f"{path}: not found"})
        except Exception as error:
            outcomes.append({"path": path, "ok": False, "error": f"{path}: {error}"})
    return outcomes


def write_result(df: DataFrame, base: str, namespace: str, name: str, fmt: str = "parquet") -> str:
    """Write a query result below the namespace's own prefix."""
    path = f"{base.rstrip('/')}/results/{namespace}/{name}"
    write_files(df, path, fmt, mode="overwrite")
    return path
