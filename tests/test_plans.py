"""Model runs, suites, and the shape of physical plans."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.grouping import children_per_parent
from tidewatch.operators.ordering import smallest_per_group
from tidewatch.plans import models, suites
from tidewatch.queries import QUERIES
from tidewatch.sources import catalog

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "id int, name string, value double, active boolean"
GOLDEN = [(1, "alpha", 1.1, True), (2, "beta", 2.2, False), (3, "gamma", 3.3, True)]
COLUMNS = [{"name": n, "type": t} for n, t in (("id", "int"), ("name", "string"), ("value", "double"), ("active", "boolean"))]
EXAMPLE = "SELECT 1 AS id, 'alpha' AS name, 10.5 AS value UNION ALL SELECT 2, 'bravo', 20.25 UNION ALL SELECT 3, 'charlie', 30.75"


def outcome(df):
    return {r["unique_id"]: (r["status"], r["message"]) for r in df.collect()}


def test_model_run(spark, tmp_path):
    nodes = models.run_models(
        spark,
        "models_ok",
        [("example", EXAMPLE)],
        [
            ("matches", f"(({EXAMPLE}) EXCEPT SELECT * FROM models_ok.example) UNION ALL (SELECT * FROM models_ok.example EXCEPT ({EXAMPLE}))"),
            ("two_large", "SELECT * FROM models_ok.example WHERE value > 20"),
        ],
        location=str(tmp_path),
    )
    assert outcome(nodes) == {
        "model.example": ("success", None),
        "test.matches": ("pass", None),
        "test.two_large": ("fail", "2 rows"),
    }
    assert not spark.catalog.tableExists("models_ok.example")
    summary = models.run_summary(nodes).first()
    assert (summary["success"], summary["n_failing"]) == (False, 1)
    assert models.failing_nodes(nodes).first()["unique_id"] == "test.two_large"


def test_a_broken_model_is_reported_and_the_rest_is_dropped(spark, tmp_path):
    nodes = models.run_models(
        spark, "models_bad", [("good", EXAMPLE), ("bad", "SELECT nope FROM models_bad.good")], [("t", "SELECT 1 WHERE false")], location=str(tmp_path)
    )
    got = outcome(nodes)
    assert got["model.good"][0] == "success" and got["test.t"][0] == "pass"
    assert got["model.bad"][0] == "error" and "nope" in got["model.bad"][1]
    assert spark.sql("SHOW TABLES IN models_bad").count() == 0


def test_summary(spark, rows):
    nodes = spark.createDataFrame(
        [("model.a", "success", 0.1, None), ("model.b", "success", 0.1, None), ("model.c", "error", 0.1, "boom")], models.NODE
    )
    assert rows(models.status_counts(nodes)) == [("error", 1), ("success", 2)]
    assert models.failing_nodes(nodes).first()["unique_id"] == "model.c"
    assert tuple(models.run_summary(nodes.where("status = 'success'")).first())[:3] == (2, 0, True)


def test_format_suite(spark, tmp_path):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    got = {r["name"]: r for r in suites.format_round_trip(df, COLUMNS, "id", str(tmp_path), "r1").collect()}
    assert {n: r["outcome"] for n, r in got.items() if n != "e2e_avro"} == {
        "e2e_csv": "PASS",
        "e2e_json": "PASS",
        "e2e_parquet": "PASS",
        "cleanup": "SUCCESS",
    }
    assert got["e2e_avro"]["outcome"] in ("PASS", "SKIPPED")
    assert not (tmp_path / "platform" / "e2e_csv" / "run_id=r1").exists()


def test_format_suite_names_a_failing_phase(spark, tmp_path):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    narrowed = [{**c, "type": "int"} if c["name"] == "value" else c for c in COLUMNS]
    got = {r["name"]: r for r in suites.format_round_trip(df, narrowed, "id", str(tmp_path), "r1", ("parquet", "orc")).collect()}
    assert (got["e2e_parquet"]["outcome"], got["e2e_parquet"]["phase"]) == ("FAIL", "validate")
    assert (got["e2e_orc"]["outcome"], got["e2e_orc"]["phase"]) == ("FAIL", "write")


def test_result_document(spark, rows):
    def results(outcome, cleanup="SUCCESS", error=None):
        return spark.createDataFrame(
            [("e2e_csv", "PASS", "validate", None), ("e2e_json", outcome, "query", "boom"), ("cleanup", cleanup, "cleanup", error)],
            suites.OUTCOME,
        )

    good = suites.result_document(results("PASS"), "r1")
    assert good.first()["status"] == "PASS" and len(good.first()["tables"]) == 2
    assert good.first()["cleanup"]["errors"] == []
    assert rows(suites.document_metrics(good)) == [("CleanupSuccess", 1), ("TestSuccess", 1)]
    for outcome in ("FAIL", "SKIPPED"):
        bad = suites.result_document(results(outcome, "FAIL", "k: gone"), "r1")
        assert bad.first()["status"] == "FAIL" and bad.first()["cleanup"]["errors"] == ["k: gone"]
        assert rows(suites.document_metrics(bad)) == [("CleanupSuccess", 0), ("TestSuccess", 0)]


def test_run_table_suite(spark, tmp_path):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    database = catalog.ensure_database(spark, "suite_db", str(tmp_path))
    for run in ("r1", "r2"):
        got = suites.run_table_round_trip(df, COLUMNS, "id", f"{database}.t", run).first()
        assert tuple(got) == (run, "PASS", "validate", None, "SUCCESS")
    got = suites.run_table_round_trip(df, COLUMNS, "id", "no_such_database.t", "r3").first()
    assert (got["status"], got["phase"], got["cleanup"]) == ("FAIL", "create_table", "SKIPPED")


@pytest.mark.parametrize(
    ("service", "reason", "expected"),
    [
        ("S3Tables", None, "FAIL"),
        ("S3Tables", "User is NOT AUTHORIZED", "PASS"),
        ("S3Tables", "timeout", "FAIL"),
        ("Redshift", "timeout", "INCONCLUSIVE"),
        ("Redshift", "", "INCONCLUSIVE"),
        ("Redshift", "Insufficient permission", "PASS"),
        ("Redshift", None, "FAIL"),
    ],
)
def test_negative_outcome(spark, service, reason, expected):
    df = spark.createDataFrame([(service, reason)], "service string, reason string")
    assert df.select(suites.negative_outcome(F.col("service"), F.col("reason"))).first()[0] == expected


def test_check_metrics(spark):
    checks = spark.createDataFrame(
        [
            ("Redshift", "lf_tag", "negative", "INCONCLUSIVE"),
            ("Redshift", "lf_tag", "positive", "INCONCLUSIVE"),
            ("S3Tables", "resource_permission", "positive", "PASS"),
            ("S3Tables", "resource_permission", "negative", "SKIPPED"),
        ],
        "service string, mechanism string, polarity string, outcome string",
    )
    cleanups = spark.createDataFrame([("S3Tables", "SUCCESS"), ("Redshift", "SKIPPED")], "service string, outcome string")
    got = {r["metric"]: r["value"] for r in suites.check_metrics(checks, cleanups).collect()}
    assert len(got) == 10
    assert {m for m, v in got.items() if v} == {
        "RedshiftLfTagNegativeCheckSuccess",
        "S3TablesResourcePermissionPositiveCheckSuccess",
        "S3TablesCleanupSuccess",
    }


def test_nothing_failed_is_success(spark):
    df = spark.createDataFrame([], "outcome string")
    assert suites.all_true(df, F.col("outcome") == "PASS").first()[0] is True
    assert suites.success_metric(df, F.col("outcome") == "PASS").first()[0] == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(QUERIES) if n[0] in "bcdefghkl" or n in ("j05_positive_check", "j06_negative_check", "j09_suite_roll_up")],
)
def test_no_product_and_no_row_udf(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["b02_equality_filter"](spark, SF_DIR))
    assert "EqualTo(o_orderpriority,1-URGENT)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderpriority:string>" in text


def test_one_shuffle_per_aggregate(spark):
    text = plan(QUERIES["d06_metric_sum"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text


def test_rank_limit_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 AS g", "id AS v")
    assert plan(smallest_per_group(df, ["g"], "v", 2)).count("WindowGroupLimit") == 2


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["f02_latest_documents"](spark, SF_DIR))


def test_lists_read_their_table_once(spark):
    df = spark.range(10).selectExpr("id % 2 AS p", "id AS c")
    text = plan(children_per_parent(df, ["p"], "c"))
    assert text.count("Range (") == 1 and "Join" not in text and "collect" not in text
