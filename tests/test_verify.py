import pytest
from pyspark.sql import functions as F

from tidewatch.operators.history import apply_snapshot, drift
from tidewatch.operators.verify import (
    digests,
    key_differences,
    multiset_difference,
    must_be_empty,
    suspects,
    symmetric_difference,
    validate,
)

SCHEMA = "id int, name string, value double, active boolean"
GOLDEN = [(1, "alpha", 1.1, True), (2, "beta", 2.2, False), (3, "gamma", 3.3, True)]


@pytest.fixture
def golden(spark):
    return spark.createDataFrame(GOLDEN, SCHEMA)


def verdict(expected, actual, **options):
    return tuple(validate(expected, actual, "id", **options).first())


def test_equal(spark, golden):
    assert verdict(golden, golden.orderBy(F.desc("id"))) == (True, None)


def test_text_results_are_coerced(spark, golden):
    text = spark.createDataFrame(
        [("3", "gamma", "3.3", "TRUE"), ("1", "alpha", "1.1", "1"), ("2", "beta", "2.2", "false")],
        "id string, name string, value string, active string",
    )
    assert verdict(golden, text) == (True, None)


def test_count_comes_first(spark, golden):
    wrong = golden.where("id < 3").withColumn("name", F.lit("x"))
    assert verdict(golden, wrong) == (False, "Row count mismatch: expected 3, got 2")


def test_coercion_comes_second(spark, golden):
    wrong = golden.withColumn("value", F.when(F.col("id") == 2, "n/a").otherwise("1.0"))
    assert verdict(golden, wrong) == (False, "Failed to coerce results: 1 rows")


def test_columns_come_third(spark, golden):
    wider = golden.withColumn("extra", F.lit(1))
    ok, detail = verdict(golden, wider)
    assert not ok and detail.startswith("Column mismatch: expected ['active', 'id', 'name', 'value'], got [")
    assert verdict(golden, wider, check_columns=False) == (True, None)


def test_first_differing_row_is_named(spark, golden):
    wrong = golden.withColumn("value", F.when(F.col("id") > 1, F.col("value") + 1).otherwise(F.col("value")))
    ok, detail = verdict(golden, wrong)
    assert not ok
    assert detail == (
        'Row 1 mismatch: expected {"active":false,"id":2,"name":"beta","value":2.2},'
        ' got {"active":false,"id":2,"name":"beta","value":3.2}'
    )


def test_other_key_at_the_same_place(spark, golden):
    other = golden.withColumn("id", F.when(F.col("id") == 2, 9).otherwise(F.col("id")))
    ok, detail = verdict(golden, other)
    assert not ok and detail.startswith("Row 1 mismatch") and '"id":2' in detail and '"id":3' in detail.split("got")[1]


def test_copies_are_counted(spark, golden):
    a = golden.unionByName(golden.where("id = 1"))
    b = golden.unionByName(golden.where("id = 2"))
    assert not verdict(a, b)[0]
    got = {(r["id"], r["surplus"]) for r in multiset_difference(a, b).collect()}
    assert got == {(1, 1), (2, -1)}


def test_null_keeps_its_place(spark):
    a = spark.createDataFrame([(1, None, "x")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "x", None)], "id int, a string, b string")
    assert not verdict(a, b)[0]
    assert digests(a, ["id"], a.columns).first()["total"] != digests(b, ["id"], b.columns).first()["total"]


def test_null_is_not_empty_text(spark):
    a = spark.createDataFrame([(1, None)], "id int, a string")
    b = spark.createDataFrame([(1, "")], "id int, a string")
    assert not verdict(a, b)[0]


def test_tolerance(spark, golden):
    near = golden.withColumn("value", F.col("value") + 1e-9)
    assert not verdict(golden, near)[0]
    assert verdict(golden, near, tolerance=1e-6)[0]
    a = spark.createDataFrame([(1, 0.0499)], "id int, value double")
    b = spark.createDataFrame([(1, 0.0501)], "id int, value double")
    assert verdict(a, b, tolerance=0.1)[0] and not verdict(a, b, tolerance=1e-4)[0]
    assert not verdict(golden, near.withColumn("name", F.lit("x")), tolerance=1e-6)[0]


def test_nothing_runs_before_the_row_is_asked_for(spark, golden):
    broken = golden.withColumn("value", F.raise_error(F.lit("ran")).cast("double"))
    assert validate(golden, broken, "id").columns == ["ok", "detail"]


def test_empty_tables(spark, golden):
    empty = golden.where("false")
    assert verdict(empty, empty) == (True, None)
    assert verdict(golden, empty) == (False, "Row count mismatch: expected 3, got 0")


@pytest.mark.parametrize("damage", ["name = 'z'", "value = -1.0", "active = NULL"])
def test_every_column_counts(spark, golden, damage):
    column, value = damage.split(" = ")
    damaged = golden.withColumn(column, F.when(F.col("id") == 3, F.expr(value)).otherwise(F.col(column)))
    assert not verdict(golden, damaged)[0]


def test_large_tables_with_a_hot_key(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    assert verdict(rows, rows.repartition(7)) == (True, None)
    changed = rows.withColumn("v", F.when(F.col("v") == 3000, -1).otherwise(F.col("v")))
    assert not verdict(rows, changed)[0]
    only = key_differences(rows, changed, ["id"]).collect()
    assert [(r["id"], r["status"]) for r in only] == [(5, "changed")]


def test_symmetric_difference_reports_missing_rows(spark):
    e = spark.createDataFrame([(1,), (2,)], "id int")
    a = spark.createDataFrame([(1,)], "id int")
    assert [tuple(r) for r in symmetric_difference(e, a).collect()] == [(2, "left")]
    assert [tuple(r) for r in symmetric_difference(a, e).collect()] == [(2, "right")]
    # Written without parentheses the same text never reports a missing row.
    e.createOrReplaceTempView("e")
    a.createOrReplaceTempView("a")
    flat = "SELECT * FROM e EXCEPT SELECT * FROM a UNION ALL SELECT * FROM a EXCEPT SELECT * FROM e"
    assert spark.sql(flat).count() == 0


def test_must_be_empty(spark, golden):
    assert tuple(must_be_empty(golden.where("id > 3"), "t").first()) == ("t", 0, True)
    assert tuple(must_be_empty(golden, "t").first()) == ("t", 3, False)


def test_drift(spark, rows):
    declared = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, p string, q string")
    actual = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "d", "z")], "id int, p string, q string")
    assert rows(drift(declared, actual, "id")) == [(2, "changed", "q"), (3, "removed", ""), (4, "added", "")]


def test_history(spark, rows):
    schema = "id int, v string"
    days = [
        ("d1", [(1, "a"), (2, "b")]),
        ("d2", [(1, "a"), (2, "c"), (3, "x")]),
        ("d3", [(1, "a"), (3, None)]),
        ("d4", [(1, "a"), (2, "c"), (3, None)]),
    ]
    history = None
    for day, data in days:
        history = apply_snapshot(history, spark.createDataFrame(data, schema), "id", day)
    assert rows(history, "id", "v", "valid_from", "valid_to") == [
        (1, "a", "d1", None),
        (2, "b", "d1", "d2"),
        (2, "c", "d2", "d3"),
        (2, "c", "d4", None),
        (3, "x", "d2", "d3"),
        (3, None, "d3", None),
    ]


@pytest.mark.parametrize("tolerance", [None, 0.01])
def test_rows_without_a_key_count(spark, tolerance):
    schema = "id int, name string, value double"
    base = [(None, "a", 1.0), (None, "b", 2.0), (1, "b", 3.0)]
    expected = spark.createDataFrame(base, schema)

    def against(changed):
        return verdict(expected, spark.createDataFrame(changed, schema), tolerance=tolerance)

    assert against(base[::-1]) == (True, None)
    ok, detail = against([(None, "x", 1.0), *base[1:]])
    assert not ok and detail.startswith('Row 0 mismatch: expected {"id":null,"name":"a"') and '"name":"b"' in detail.split("got")[1]
    ok, detail = against([*base[:2], (1, "c", 3.0)])
    assert not ok and detail.startswith('Row 2 mismatch: expected {"id":1,"name":"b"')
    # A key on one side only.
    assert not against([(2, "a", 1.0), *base[1:]])[0]
    assert not verdict(spark.createDataFrame([(2, "a", 1.0), *base[1:]], schema), expected, tolerance=tolerance)[0]
    nothing = spark.createDataFrame([(None, None, None)] * 2, schema)
    assert verdict(nothing, nothing, tolerance=tolerance) == (True, None)
    assert verdict(nothing, spark.createDataFrame([(None, None, None), (None, None, 0.0)], schema), tolerance=tolerance)[0] is False


def test_only_differing_leaves_are_compared(spark):
    rows = spark.range(200_000).selectExpr("CAST(id AS INT) AS id", "CAST(id % 7 AS STRING) AS name")
    wrong = F.col("id") % 100 == 0
    changed = rows.withColumn("name", F.when(wrong, "x").otherwise(F.col("name")))
    both = rows.withColumn("_side", F.lit(1)).unionByName(changed.withColumn("_side", F.lit(-1)))
    # Nearly every bucket holds one of the 2,000 differing keys, and hardly any other key comes with them.
    assert digests(changed, ["id"], ["id", "name"]).count() == 4096
    found = suspects(both, "id", ["id", "name"])
    keys = {r["id"] for r in found.select("id").distinct().collect()}
    assert {i for i in range(0, 200_000, 100)} <= keys and len(keys) < 2_100
    assert found.columns == both.columns
    ok, detail = verdict(rows, changed)
    assert not ok and detail.startswith("Row 0 mismatch")
    assert suspects(rows.withColumn("_side", F.lit(1)).unionByName(rows.withColumn("_side", F.lit(-1))), "id", ["id", "name"]).count() == 0
