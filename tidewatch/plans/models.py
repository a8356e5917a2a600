"""SQL models: seed, build, test, tear down, and a summary of the run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.grouping import children_per_parent
from tidewatch.sources.catalog import ensure_database, quoted
from tidewatch.sources.files import read_files

NODE = "unique_id string, status string, execution_time double, message string"
FAILING = ("error", "fail")


def seed(spark: SparkSession, path: str, columns: list[dict], table: str) -> DataFrame:
    """Load a CSV with declared columns into a table."""
    read_files(spark, path, "csv", columns).write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def build(spark: SparkSession, table: str, sql: str) -> DataFrame:
    """Materialise a model, replacing what an earlier run left."""
    spark.sql(sql).write.mode("overwrite").saveAsTable(table)
    return spark.table(table)


def run_models(
    spark: SparkSession,
    database: str,
    models: list[tuple[str, str]],
    tests: list[tuple[str, str]],
    keep: bool = False,
    location: str | None = None,
) -> DataFrame:
    """Build models in order, run tests, and drop the tables whatever happened.

    A test passes when its query returns no rows; only their number reaches the
    driver. Returns one row per node: ``unique_id, status, execution_time, message``.
    """
    ensure_database(spark, database, location)
    nodes, built = [], []
    try:
        for name, sql in models:
            built.append(f"{database}.{name}")
            nodes.append(_node(f"model.{name}", "success", lambda: build(spark, f"{database}.{name}", sql)))
        for name, sql in tests:
            nodes.append(_node(f"test.{name}", "pass", lambda: _failures(spark, sql)))
    finally:
        if not keep:
            for table in built:
                spark.sql(f"DROP TABLE IF EXISTS {quoted(table)}")
    return spark.createDataFrame(nodes, NODE)


def _failures(spark: SparkSession, sql: str) -> str | None:
    failures = spark.sql(sql).count()
    return f"{failures} rows" if failures else None


def _node(unique_id: str, good: str, action) -> tuple:
    start = time.monotonic()
    status, message = good, None
    try:
        outcome = action()
        if isinstance(outcome, str):
            status, message = "fail", outcome
    except Exception as error:
        status, message = "error", str(error).splitlines()[0]
    return unique_id, status, time.monotonic() - start, message


def status_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_summary(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Success of a run, per group of ``by``; ``failing_nodes`` names what failed."""
    failing = F.count_if(F.col("status").isin(*FAILING))
    totals = nodes.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_nodes"), failing.alias("n_failing"))
    return totals.withColumn("success", F.col("n_failing") == 0)


def failing_nodes(nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by, unique_id, n_rows)``: every failing node of every run."""
    return children_per_parent(nodes.where(F.col("status").isin(*FAILING)), by or [], "unique_id")
