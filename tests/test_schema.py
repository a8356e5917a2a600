import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.schema import UnsupportedType, apply_schema, schema_violations, spark_type, struct_type


def columns(**types):
    return [{"name": n, "type": t} for n, t in types.items()]


@pytest.mark.parametrize(
    ("declared", "family", "expected"),
    [
        ("decimal(10,2)", "landing", "decimal(10,2)"),
        ("decimal", "landing", "decimal(10,0)"),
        ("varchar(255)", "landing", "string"),
        ("char(3)", "landing", "string"),
        ("tinyint", "landing", "tinyint"),
        ("array<int>", "landing", "array<int>"),
        ("map<string,array<int>>", "landing", "map<string,array<int>>"),
        ("struct<a:int,b:string>", "landing", "struct<a:int,b:string>"),
        ("timestamp", "acid", "timestamp_ntz"),
        ("timestamptz", "acid", "timestamp"),
        ("uuid", "acid", "string"),
        ("fixed( 16 )", "acid", "binary"),
        ("decimal(38, 38)", "acid", "decimal(38,38)"),
    ],
)
def test_types(spark, declared, family, expected):
    assert spark_type(declared, family) == expected


@pytest.mark.parametrize(
    ("declared", "family"),
    [
        ("decimal(39,0)", "landing"),
        ("decimal(2,3)", "landing"),
        ("decimal(0,0)", "acid"),
        ("uniontype<int,string>", "landing"),
        ("array<uniontype<int,string>>", "landing"),
        ("map<array<int>,int>", "landing"),
        ("time", "acid"),
        ("long", "landing"),
        ("bigint", "acid"),
        ("fixed(4)", "landing"),
        ("varchar(4)", "acid"),
        ("array<int>", "acid"),
    ],
)
def test_refused_types(spark, declared, family):
    with pytest.raises(UnsupportedType):
        spark_type(declared, family)


def test_struct_type_keeps_required(spark):
    schema = struct_type([{"name": "Id", "type": "int", "required": True}, {"name": "v", "type": "double"}])
    assert schema.fieldNames() == ["id", "v"]
    assert [f.nullable for f in schema] == [False, True]


def test_text_values(spark, rows):
    raw = spark.createDataFrame(
        [("1", "1.5", "TRUE", "2024-01-02"), ("1.5", "", "1", ""), ("99999999999", "x", "yes", "soon"), (None,) * 4],
        "i string, d string, b string, t string",
    )
    typed = apply_schema(raw, columns(i="int", d="double", b="boolean", t="date"))
    got = rows(typed.withColumn("t", F.col("t").cast("string")))
    assert got == [
        (1, 1.5, True, "2024-01-02"),
        (None, None, False, None),
        (None, None, True, None),
        (None, None, None, None),
    ]


def test_numeric_limits(spark, rows):
    raw = spark.createDataFrame(
        [(127, 127.9, 9.994), (128, 128.0, 9.995), (-128, -128.9, -9.99), (-129, float("nan"), 10.0)],
        "a bigint, b double, c double",
    )
    typed = apply_schema(raw, columns(a="tinyint", b="tinyint", c="decimal(3,2)"))
    assert [tuple(r) for r in typed.select("a", "b", F.col("c").cast("double")).collect()] == [
        (127, 127, 9.99),
        (None, None, None),
        (-128, -128, -9.99),
        (None, None, None),
    ]


def test_violations(spark, rows):
    raw = spark.createDataFrame(
        [("1", "abc", b"1234", "9b2c1f00-0000-0000-0000-000000000000"), ("x", "abcd", b"123", "nope"), (None, None, None, None)],
        "i string, s string, f binary, u string",
    )
    declared = [
        {"name": "i", "type": "int", "required": True},
        {"name": "s", "type": "string"},
        {"name": "f", "type": "fixed(4)"},
        {"name": "u", "type": "uuid"},
    ]
    assert rows(schema_violations(raw, declared, "acid")) == [
        ("f", "size", 1),
        ("i", "required", 1),
        ("i", "type", 1),
        ("u", "format", 1),
    ]


def test_declared_int_over_wide_file(spark, tmp_path):
    from tidewatch.sources.files import read_files

    path = str(tmp_path / "wide")
    spark.range(3).selectExpr("id", "id * 3000000000 AS big").write.parquet(path)
    got = read_files(spark, path, "parquet", columns(id="int", big="int"))
    assert [f.dataType for f in got.schema] == [T.IntegerType(), T.IntegerType()]
    assert sorted((r["id"], r["big"]) for r in got.collect()) == [(0, 0), (1, None), (2, None)]
