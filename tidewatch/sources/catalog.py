"""Catalog databases and external tables over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.functions.schema import struct_type
from tidewatch.sources.files import check_format


def quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def text_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def database_name(environment: str, namespace: str, prefix: str = "platform") -> str:
    return f"{prefix}_{environment}_{namespace.replace('-', '_')}".lower()


def ensure_database(spark: SparkSession, name: str, location: str | None = None) -> str:
    """Create a database unless it exists; a second call changes nothing."""
    where = f" LOCATION {text_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{where}")
    return name


def split_columns(columns: list[dict], partition_keys: list[str]) -> tuple[list[dict], list[dict]]:
    """Data columns and partition keys, both in declared order.

    A key outside the declared columns is refused rather than dropped.
    """
    names = [c["name"] for c in columns]
    unknown = [k for k in partition_keys if k not in names]
    if unknown:
        raise ValueError(f"partition keys are not among the columns: {', '.join(unknown)}")
    data = [c for c in columns if c["name"] not in partition_keys]
    keys = [c for k in partition_keys for c in columns if c["name"] == k]
    return data, keys


def register_external(
    spark: SparkSession,
    table: str,
    fmt: str,
    location: str,
    columns: list[dict],
    partition_keys: list[str] | None = None,
) -> DataFrame:
    """Register files as a table: declared schema, format, location, partition keys.

    Partitions already on disk are discovered, so a query sees them at once.
    """
    name = check_format(spark, fmt)
    data, keys = split_columns(columns, partition_keys or [])
    types: dict[str, T.DataType] = {f.name: f.dataType for f in struct_type(columns).fields}
    ddl = ", ".join(f"{quoted(c['name'].lower())} {types[c['name'].lower()].simpleString()}" for c in data + keys)
    options = " OPTIONS ('header' 'true', 'sep' ',')" if name == "csv" else ""
    by = f" PARTITIONED BY ({', '.join(quoted(c['name'].lower()) for c in keys)})" if keys else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({ddl}) USING {name}{options}{by}"
        f" LOCATION {text_literal(location)}"
    )
    if keys:
        discover_partitions(spark, table)
    return spark.table(table)


def discover_partitions(spark: SparkSession, table: str) -> None:
    spark.sql(f"MSCK REPAIR TABLE {quoted(table)}")
