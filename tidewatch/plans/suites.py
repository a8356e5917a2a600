"""Verification suites: round trips through formats and run tables, check matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.predicates import contains_any
from tidewatch.operators.grouping import children_per_parent
from tidewatch.operators.verify import validate
from tidewatch.sources.files import FORMATS, FormatUnavailable, land, read_files, remove_paths
from tidewatch.sources.runs import RunTable

OUTCOME = "name string, outcome string, phase string, detail string"

# Services and mechanisms of the access checks.
SERVICES = ("S3Tables", "Redshift")
MECHANISM_PREFIXES = {"resource_permission": "ResourcePermission", "lf_tag": "LfTag"}
TOLERANT_SERVICES = ("Redshift",)


def format_round_trip(
    df: DataFrame,
    columns: list[dict],
    key: str,
    base: str,
    run_id: str,
    formats: tuple[str, ...] = FORMATS,
    through: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Write, read back and compare a table in every format, then remove the run.

    One row per format, ``name, outcome, phase, detail``, plus one for the
    cleanup. A format whose data source is missing is reported as SKIPPED. What
    is read goes ``through`` a function before it is compared.
    """
    spark = df.sparkSession
    results, written = [], {}
    for fmt in formats:
        name = f"e2e_{fmt}"
        try:
            written[fmt] = land(df, base, "platform", name, run_id, fmt)
        except FormatUnavailable as missing:
            results.append((name, "SKIPPED", "write", str(missing)))
        except Exception as error:
            results.append((name, "FAIL", "write", _first_line(error)))
    for fmt, path in written.items():
        name = f"e2e_{fmt}"
        try:
            verdict = validate(df, through(read_files(spark, path, fmt, columns)), key).first()
            results.append((name, "PASS" if verdict["ok"] else "FAIL", "validate", verdict["detail"]))
        except Exception as error:
            results.append((name, "FAIL", "query", _first_line(error)))
    errors = [o["error"] for o in remove_paths(spark, list(written.values())) if not o["ok"]]
    results.append(("cleanup", "FAIL" if errors else "SUCCESS", "cleanup", "; ".join(errors) or None))
    return spark.createDataFrame(results, OUTCOME)


def result_document(results: DataFrame, run_id: str) -> DataFrame:
    """The suite's one result document: ``run_id, status, tables, cleanup``.

    Every table has to PASS; one that was skipped leaves the suite unproven.
    The results are one row per format.
    """
    is_cleanup = F.col("phase") == "cleanup"
    entry = F.struct("name", "outcome", "phase", "detail")
    passed = F.coalesce(F.bool_and(F.when(~is_cleanup, F.col("outcome") == "PASS")), F.lit(True))
    return results.agg(
        F.lit(run_id).alias("run_id"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        F.sort_array(F.collect_list(F.when(~is_cleanup, entry))).alias("tables"),
        F.struct(
            F.max(F.when(is_cleanup, F.col("outcome"))).alias("outcome"),
            F.array_compact(F.collect_list(F.when(is_cleanup, F.col("detail")))).alias("errors"),
        ).alias("cleanup"),
    )


def document_metrics(document: DataFrame) -> DataFrame:
    """The two 0/1 metrics of a result document: ``metric, value``."""
    pairs = F.array(
        F.struct(F.lit("TestSuccess").alias("metric"), (F.col("status") == "PASS").cast("int").alias("value")),
        F.struct(F.lit("CleanupSuccess").alias("metric"), (F.col("cleanup.outcome") == "SUCCESS").cast("int").alias("value")),
    )
    return document.select(F.inline(pairs))


def run_table_round_trip(
    df: DataFrame, columns: list[dict], key: str, table: str, run_id: str, through: Callable[[DataFrame], DataFrame] = lambda rows: rows
) -> DataFrame:
    """Create, insert, query, validate and delete a run of an ACID table.

    Cleanup is SKIPPED when nothing was written. What is read goes ``through`` a
    function before it is compared.
    """
    spark = df.sparkSession
    phase, status, detail, cleanup = "create_table", "FAIL", None, "SKIPPED"
    try:
        runs = RunTable(spark, table, columns).create_if_missing()
        phase = "insert"
        runs.append(df, run_id)
        cleanup = "FAIL"
        phase = "validate"
        verdict = validate(df, through(runs.rows(run_id).drop("run_id")), key, check_columns=False).first()
        status, detail = ("PASS" if verdict["ok"] else "FAIL"), verdict["detail"]
    except Exception as error:
        detail = _first_line(error)
    if cleanup != "SKIPPED":
        try:
            runs.delete(run_id)
            cleanup = "SUCCESS"
        except Exception as error:
            detail = detail or _first_line(error)
    return spark.createDataFrame(
        [(run_id, status, phase, detail, cleanup)],
        "run_id string, status string, phase string, detail string, cleanup string",
    )


def _first_line(error: Exception) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0]


def negative_outcome(service: Column, failure_reason: Column) -> Column:
    """Outcome of a forbidden write: denied passes, allowed fails.

    Another failure is INCONCLUSIVE for tolerant services and a FAIL for the rest.
    """
    return (
        F.when(failure_reason.isNull(), "FAIL")
        .when(contains_any(failure_reason), "PASS")
        .when(service.isin(*TOLERANT_SERVICES), "INCONCLUSIVE")
        .otherwise("FAIL")
    )


def counts_as_passed(polarity: Column, outcome: Column) -> Column:
    return (outcome == "PASS") | ((polarity == "negative") & (outcome == "INCONCLUSIVE"))


def check_metrics(checks: DataFrame, cleanups: DataFrame) -> DataFrame:
    """The full metric matrix: 0/1 per service, mechanism and polarity, and per cleanup.

    ``checks`` has ``service, mechanism, polarity, outcome``; ``cleanups`` has
    ``service, outcome``. A combination without any check counts as failed.
    """
    mechanism_names = F.create_map(*[F.lit(v) for pair in MECHANISM_PREFIXES.items() for v in pair])
    name = F.concat(
        "service",
        F.element_at(mechanism_names, F.col("mechanism")),
        F.initcap("polarity"),
        F.lit("CheckSuccess"),
    )
    passed = F.min(counts_as_passed(F.col("polarity"), F.col("outcome")).cast("int"))
    found = checks.groupBy("service", "mechanism", "polarity").agg(passed.alias("value")).select(name.alias("metric"), "value")
    cleaned = cleanups.groupBy("service").agg(F.min((F.col("outcome") == "SUCCESS").cast("int")).alias("value"))
    found = found.unionByName(cleaned.select(F.concat("service", F.lit("CleanupSuccess")).alias("metric"), "value"))
    wanted = [
        f"{s}{p}{polarity}CheckSuccess"
        for s in SERVICES
        for p in MECHANISM_PREFIXES.values()
        for polarity in ("Positive", "Negative")
    ] + [f"{s}CleanupSuccess" for s in SERVICES]
    spark = checks.sparkSession
    matrix = spark.createDataFrame([(m,) for m in wanted], "metric string")
    return matrix.join(found, "metric", "left").withColumn("value", F.coalesce("value", F.lit(0)))


def _failed(outcome: str, good: tuple) -> Column:
    return ~F.coalesce(F.col(outcome).isin(*good), F.lit(False))


def roll_up(outcomes: DataFrame, suite: list[str], outcome: str = "outcome", good: tuple = ("PASS",)) -> DataFrame:
    """Status per suite; a suite without failures passes. ``failing_items`` names them."""
    return (
        outcomes.groupBy(*suite)
        .agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(_failed(outcome, good)).alias("n_failing"))
        .withColumn("status", F.when(F.col("n_failing") == 0, "PASS").otherwise("FAIL"))
    )


def failing_items(
    outcomes: DataFrame, suite: list[str], item: str, outcome: str = "outcome", good: tuple = ("PASS",)
) -> DataFrame:
    """``(suite, item, n_rows)``: every failing item of every suite."""
    return children_per_parent(outcomes.where(_failed(outcome, good)), suite, item)


def success_metric(outcomes: DataFrame, ok: Column, by: list[str] | None = None, name: str = "success") -> DataFrame:
    """1 when every outcome is good, else 0; no outcomes at all count as good."""
    return outcomes.groupBy(*(by or [])).agg(F.coalesce(F.min(ok.cast("int")), F.lit(1)).alias(name))


def all_true(df: DataFrame, test: Column, name: str = "all_true") -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(test), F.lit(True)).alias(name))
