"""Sinks of the operating data: metric datapoints and run-result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_datapoints(
    df: DataFrame, namespace: str, metric: str, value: Column, dims: dict[str, Column], ts: Column, unit: str = "Count"
) -> DataFrame:
    """Rows ``namespace, metric, dims, value, unit, ts``."""
    pairs = [part for name, column in dims.items() for part in (F.lit(name), column.cast("string"))]
    return df.select(
        F.lit(namespace).alias("namespace"),
        F.lit(metric).alias("metric"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("dims"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        ts.alias("ts"),
    )


def publish(datapoints: DataFrame, path: str) -> None:
    """Append datapoints, one folder per namespace and metric for pruned reads."""
    datapoints.hint("rebalance", "namespace", "metric").write.mode("append").partitionBy(
        "namespace", "metric"
    ).parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line, nested structs kept."""
    documents.write.mode("append").json(path)
