import json
import os

import pytest
from pyspark.sql import functions as F

from tidewatch.session import materialise, scratch, shared_dir
from tidewatch.sources import catalog, files, topics
from tidewatch.sources.runs import RunTable, new_run_id

COLUMNS = [
    {"name": "id", "type": "int"},
    {"name": "name", "type": "string"},
    {"name": "value", "type": "double"},
    {"name": "active", "type": "boolean"},
]
GOLDEN = [(1, "alpha", 1.1, True), (2, "beta", 2.2, False), (3, "gamma", 3.3, True)]


@pytest.fixture
def golden(spark):
    return spark.createDataFrame(GOLDEN, "id int, name string, value double, active boolean")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(spark, golden, rows, tmp_path, fmt):
    path = str(tmp_path / fmt)
    odd = spark.createDataFrame([(4, 'quote " and, comma', None, None), (5, None, -0.5, True)], golden.schema)
    files.write_files(golden.unionByName(odd), path, fmt)
    assert rows(files.read_files(spark, path, fmt, COLUMNS)) == rows(golden.unionByName(odd))


def test_numeric_booleans_in_csv(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name,value,active\n1,a,1.0,1\n2,b,2.0,TRUE\n3,c,3.0,no\n")
    got = files.read_files(spark, str(tmp_path / "in"), "csv", COLUMNS)
    assert rows(got, "id", "active") == [(1, True), (2, True), (3, False)]


def test_unknown_format(spark, golden, tmp_path):
    with pytest.raises(files.UnknownFormat):
        files.write_files(golden, str(tmp_path / "x"), "orc")


def test_avro(spark, golden, rows, tmp_path):
    path = str(tmp_path / "avro")
    if files.avro_available(spark):
        files.write_files(golden, path, "avro")
        assert rows(files.read_files(spark, path, "avro", COLUMNS)) == rows(golden)
    else:
        with pytest.raises(files.FormatUnavailable, match="spark-avro"):
            files.write_files(golden, path, "avro")


def test_leftovers_of_another_run_stay_apart(spark, golden, rows, tmp_path):
    base = str(tmp_path)
    files.land(golden, base, "platform", "t", "old", "csv")
    path = files.land(golden.where("id > 1"), base, "platform", "t", "new", "csv")
    files.land(golden.where("id > 1"), base, "platform", "t", "new", "csv")
    assert rows(files.read_files(spark, path, "csv", COLUMNS), "id") == [(2,), (3,)]


def test_cleanup_collects_errors(spark, golden, tmp_path):
    path = files.land(golden, str(tmp_path), "platform", "t", "r", "json")
    outcomes = files.remove_paths(spark, [str(tmp_path / "absent"), path])
    assert [o["ok"] for o in outcomes] == [False, True]
    assert "not found" in outcomes[0]["error"] and not os.path.exists(path)


def test_partition_keys_must_be_declared(spark, golden, tmp_path):
    with pytest.raises(ValueError, match="region"):
        catalog.split_columns(COLUMNS, ["region"])
    with pytest.raises(ValueError, match="region"):
        files.write_files(golden, str(tmp_path / "p"), "csv", partition_by=["region"])


def test_partition_pruning_reaches_the_scan(spark, golden, tmp_path):
    path, database = str(tmp_path / "files"), catalog.ensure_database(spark, "prune_db", str(tmp_path / "db"))
    files.write_files(golden, path, "parquet", partition_by=["name"])
    table = catalog.register_external(spark, f"{database}.t", "parquet", path, COLUMNS, ["name"])
    plan = table.where("name = 'beta' AND id = 2").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(name" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,2)]" in plan
    assert table.where("name = 'beta'").count() == 1


def test_partitions_added_later_are_discovered(spark, golden, tmp_path):
    path, database = str(tmp_path / "files"), catalog.ensure_database(spark, "discover_db", str(tmp_path / "db"))
    files.write_files(golden.where("id = 1"), path, "parquet", partition_by=["name"])
    table = catalog.register_external(spark, f"{database}.t", "parquet", path, COLUMNS, ["name"])
    files.write_files(golden.where("id > 1"), path, "parquet", partition_by=["name"])
    assert table.count() == 1
    catalog.discover_partitions(spark, f"{database}.t")
    assert spark.table(f"{database}.t").count() == 3


def test_database_names():
    assert catalog.database_name("dev", "grid-meter") == "platform_dev_grid_meter"
    assert catalog.quoted("a.b`c") == "`a`.`b``c`"


def test_run_table(spark, golden, rows, tmp_path):
    database = catalog.ensure_database(spark, "runs_db", str(tmp_path))
    runs = RunTable(spark, f"{database}.t", COLUMNS).create_if_missing().create_if_missing()
    runs.append(golden, "a").append(golden.where("id = 1"), "b")
    assert runs.rows("a").count() == 3 and runs.rows().count() == 4
    runs.delete("a")
    runs.delete("a")
    assert rows(runs.rows(), "id", "run_id") == [(1, "b")]
    plan = runs.rows("b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan
    runs.drop()
    assert not spark.catalog.tableExists(f"{database}.t")


def test_run_ids_differ():
    assert new_run_id() != new_run_id()


def test_run_table_refusals(spark):
    with pytest.raises(ValueError, match="lower case"):
        RunTable(spark, "Db.T", COLUMNS)
    with pytest.raises(ValueError):
        RunTable(spark, "db.t", COLUMNS, provider="csv")


def test_broker_options():
    options = topics.consumer_options("b:9092", "t", {1: 5, 0: 7})
    assert json.loads(options["startingOffsets"]) == {"t": {"0": 7, "1": 5}}
    assert json.loads(options["assign"]) == {"t": [0, 1]}
    assert topics.producer_options("b:9092", "t")["kafka.acks"] == "all"


def test_broker_needs_connector(spark):
    records = spark.createDataFrame([("k", "v")], "key string, value string")
    if not topics.kafka_available(spark):
        with pytest.raises(RuntimeError, match="connector"):
            topics.produce(records, servers="b:9092", topic="t")
        with pytest.raises(RuntimeError, match="connector"):
            topics.read_broker(spark, "b:9092", "t", {0: 1})


def test_topic_names(spark):
    name = topics.topic_name("dev", F.lit("retail"), F.lit("web"), F.lit("page-view"))
    row = spark.range(1).select(name.alias("topic")).select(
        *[c.alias(n) for n, c in topics.topic_parts(F.col("topic")).items()]
    )
    assert tuple(row.first()) == ("dev", "retail", "web", "page-view")


@pytest.mark.parametrize(
    ("value", "k"),
    [
        ('{"k": 1}', 1),
        (' {"k": 1} ', 1),
        ('{"k": "x"}', None),
        ("{}", None),
        ('{"k": 1, "a": [[1],[2]]}', 1),
    ],
)
def test_decodable(spark, value, k):
    body = topics.decode(spark.createDataFrame([(value,)], "value string"), "k int").first()["body"]
    assert body is not None and body["k"] == k


@pytest.mark.parametrize(
    "value", [None, "", "{", '{"k": 1}}', '{"k": 1} x', '{"k": 1},{"k": 2}', '{"k": 1}],[{"k": 2}', "5", "[]", "null", '"s"']
)
def test_undecodable(spark, value):
    assert topics.decode(spark.createDataFrame([(value,)], "value string"), "k int").first()["body"] is None


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch(spark, "x").startswith(shared_dir(spark))
    assert scratch(spark, "x") != scratch(spark, "x")


def test_materialise(spark, rows):
    df = spark.range(5).selectExpr("id", "CASE WHEN id > 3 THEN id END AS v")
    kept = materialise(df)
    assert rows(kept) == rows(df)
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert materialise(df.where("id < 0")).count() == 0


def test_rows_are_deleted_inside_shared_files(spark, rows, tmp_path):
    from tidewatch.sources import rewrite

    path = str(tmp_path / "shared files")
    df = spark.range(40).selectExpr("id", "IF(id % 10 = 9, NULL, 'r' || id % 4) AS run")
    for low in (0, 20):
        df.where(F.col("id").between(low, low + 19)).coalesce(1).write.mode("append").parquet(path)
    df.where("id = 0").selectExpr("id + 100 AS id", "'r9' AS run").coalesce(1).write.mode("append").parquet(path)
    before = {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").where("run = 'r9'").collect()}
    gone = F.col("run") == "r2"
    want = [r for r in rows(spark.read.parquet(path)) if r[1] != "r2"]
    assert rewrite.delete_rows(spark, path, gone) == 2
    assert rows(spark.read.parquet(path)) == want and len(want) == 31
    assert rewrite.delete_rows(spark, path, gone) == 0
    # A file without such rows is the same file as before.
    after = {r[0] for r in spark.read.parquet(path).select("_metadata.file_path").where("run = 'r9'").collect()}
    assert after == before


@pytest.mark.parametrize("stop_after", ["staged", "decided", "renamed"])
def test_an_interrupted_delete_is_finished_or_taken_back(spark, rows, tmp_path, monkeypatch, stop_after):
    from tidewatch.sources import rewrite

    path = str(tmp_path / "t")
    spark.range(20).coalesce(2).write.parquet(path)
    real = {"literal_rows": rewrite.literal_rows, "_swap": rewrite._swap, "delete_path": rewrite.delete_path}

    def stop(*args):
        raise InterruptedError

    monkeypatch.setattr(rewrite, {"staged": "literal_rows", "decided": "_swap", "renamed": "delete_path"}[stop_after], stop)
    with pytest.raises(InterruptedError):
        rewrite.delete_rows(spark, path, F.col("id") < 5)
    for name, function in real.items():
        monkeypatch.setattr(rewrite, name, function)
    assert rewrite.recover(spark, path) == (0 if stop_after == "staged" else 1)
    left = [r[0] for r in rows(spark.read.parquet(path))]
    assert sorted(left) == list(range(0 if stop_after == "staged" else 5, 20))
    assert rewrite.recover(spark, path) == 0


def test_runs_in_shared_files(spark, rows, tmp_path):
    from tidewatch.sources.catalog import ensure_database
    from tidewatch.sources.runs import RunTable

    ensure_database(spark, "shared_runs", str(tmp_path / "db"))
    table = RunTable(spark, "shared_runs.t", [{"name": "id", "type": "long"}], shared_files=True).create_if_missing()
    table.append_runs(spark.range(9).coalesce(1), F.concat(F.lit("r"), F.col("id") % 3))
    table.append(spark.range(100, 102), "r1")
    table.delete("r1")
    table.delete("none")
    assert rows(table.rows(), "id") == [(0,), (2,), (3,), (5,), (6,), (8,)]
    table.append(spark.range(50, 51), "r1")
    assert rows(table.rows("r1"), "id") == [(50,)]


def test_partitions_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    # With this setting a task writes its keys side by side; 40 keys are more than it allows, the rest is sorted.
    name, path, seen = "spark.sql.maxConcurrentOutputFileWriters", str(tmp_path / "keys"), []
    rows = spark.range(4000).selectExpr("id", "id % 40 AS k")
    save, before = type(rows.write).save, spark.conf.get(name)
    monkeypatch.setattr(type(rows.write), "save", lambda self, *a: (seen.append(int(spark.conf.get(name))), save(self, *a)))
    files.write_files(rows, path, "parquet", partition_by=["k"])
    assert seen == [files.OPEN_FILES] and spark.conf.get(name) == before
    found = spark.read.parquet(path)
    assert found.count() == 4000 and found.where("id % 40 <> k").isEmpty() and found.select("k").distinct().count() == 40
