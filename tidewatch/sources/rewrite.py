"""Row-level deletes on plain Parquet folders: only files that hold such rows are written anew."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import delete_path, existing, literal_rows, rename_path

_STAGED, _NEW, _OLD = "_delete-", "new", "old"


def delete_rows(spark: SparkSession, path: str, condition: Column, schema=None) -> int:
    """Delete the rows of an unpartitioned folder that meet ``condition``; the number of files written anew.

    Rows for which the condition is NULL stay. The files that hold such rows are
    found by one pruned scan; their other rows are written next to the table,
    together with the list of files they replace, and then take their place.
    Files without such rows are never touched. A delete that was interrupted is
    finished, or taken back if its rows were not all written, by the next one or
    by ``recover``. While files change places a reader may see rows of both; a
    table format with snapshots avoids that.
    """
    recover(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    held = reader.parquet(path).where(condition).select(F.col("_metadata.file_path").alias("file")).distinct()
    # One name per file that holds such rows.
    files = sorted(unquote(row["file"]) for row in held.collect())
    if not files:
        return 0
    staged = f"{path.rstrip('/')}/{_STAGED}{uuid.uuid4().hex}"
    _survivors(reader.parquet(*files), condition).write.parquet(f"{staged}/{_NEW}")
    # The list comes last: with it the delete is decided.
    literal_rows(spark, [(f,) for f in files], "file string").coalesce(1).write.parquet(f"{staged}/{_OLD}")
    _swap(spark, path, staged)
    return len(files)


def _survivors(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~F.coalesce(condition, F.lit(False)))


def recover(spark: SparkSession, path: str) -> int:
    """Finish deletes that were decided, remove the leftovers of others; how many were finished."""
    finished = 0
    for staged in existing(spark, f"{path.rstrip('/')}/{_STAGED}*"):
        if existing(spark, f"{staged}/{_OLD}/_SUCCESS"):
            _swap(spark, path, staged)
            finished += 1
        else:
            delete_path(spark, staged)
    return finished


def _swap(spark: SparkSession, path: str, staged: str) -> None:
    """New files in, old files out, then the list; each step may be done again."""
    for file in existing(spark, f"{staged}/{_NEW}/part-*"):
        rename_path(spark, file, f"{path.rstrip('/')}/{file.rsplit('/', 1)[1]}")
    for row in spark.read.schema("file string").parquet(f"{staged}/{_OLD}").collect():
        delete_path(spark, row["file"])
    delete_path(spark, staged)
