"""Small helpers that run Python over Arrow batches of a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_columns(df: DataFrame, inputs: list, added: str, compute: Callable[..., list[pa.Array]]) -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, computed batch by batch.

    ``compute`` gets one Arrow array per input expression and returns one array
    per added column. A column of ``df`` that has an added name is replaced.
    """
    new = T.StructType.fromDDL(added)
    kept = [df[f"`{c}`"] for c in df.columns if c not in new.names]
    n = len(kept)
    fed = df.select(*kept, *[F.col(c) if isinstance(c, str) else c for c in inputs])
    schema = T.StructType(fed.schema.fields[:n] + new.fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays(columns[:n] + compute(*columns[n:]), names=names)

    return fed.mapInArrow(run, schema)


def texts(array: pa.Array) -> list[str]:
    """Strings of an Arrow array; a missing text counts as empty."""
    return ["" if t is None else t for t in array.to_pylist()]


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for jobs that run inside and whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
