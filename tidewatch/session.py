"""Session set-up, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LOCAL_DIRS: dict[str, str] = {}
_STAGES: dict[str, list[str]] = {}


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and the zone pinned to UTC.

    Shuffle width is left to the cluster's own setting unless given.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # State of large streams lives on local disk instead of the heap.
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master only; a
    cluster without the setting is refused, because a machine-local folder
    would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="tidewatch-")
        _delete_at_exit(spark, _LOCAL_DIRS[application])
    return _LOCAL_DIRS[application]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or cleared."""
    return os.path.join(shared_dir(spark), "tidewatch", f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder.

    It survives lost executors like a checkpoint does, and as a columnar file
    it also gives the optimizer sizes and prunes columns when read again. The
    table is deleted when the application ends, or before by ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.parquet(path)
    _delete_at_exit(spark, path)
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``materialise`` wrote and that are still there."""
    return list(_STAGES.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables that ``materialise`` wrote (default: all so far) and return their number.

    For long sessions, once the results that read them have been written.
    """
    held = _STAGES.get(spark.sparkContext.applicationId, [])
    paths = [p for p in held if paths is None or p in paths]
    _STAGES[spark.sparkContext.applicationId] = [p for p in held if p not in paths]
    for path in paths:
        target, files = _file_system(spark, path)
        files.delete(target, True)
    return len(paths)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in the store that Spark reads."""
    target, files = _file_system(spark, pattern)
    return [str(status.getPath().toString()) for status in files.globStatus(target) or []]


def make_folder(spark: SparkSession, path: str) -> None:
    """Create a folder unless it is there."""
    target, files = _file_system(spark, path)
    files.mkdirs(target)


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; whether it was there."""
    target, files = _file_system(spark, path)
    return files.delete(target, True)


def rename_path(spark: SparkSession, path: str, to: str) -> None:
    target, files = _file_system(spark, path)
    if not files.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.deleteOnExit(target)


def source_available(spark: SparkSession, name: str) -> bool:
    """Whether a data source that ships apart from Spark is on the classpath."""
    lookup = spark._jvm.org.apache.spark.sql.execution.datasources.DataSource
    try:
        lookup.lookupDataSource(name, spark._jsparkSession.sessionState().conf())
        return True
    except Exception:
        return False


def literal_rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A definition table from Python literals; Spark knows its size and picks the join."""
    return spark.createDataFrame(rows, schema)
