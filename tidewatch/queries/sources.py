"""Scans, landing, catalog tables, run tables and sinks."""

from __future__ import annotations

import glob
import os

import pyspark
from pyspark.sql import functions as F

from tidewatch.operators import history
from tidewatch.plans import models
from tidewatch.queries import columns as C
from tidewatch.queries.registry import query, table
from tidewatch.session import scratch
from tidewatch.sources import catalog, files, metric_sink, record_log, topics
from tidewatch.sources.runs import RunTable
from tidewatch.streaming import runs as streams

ALL_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _database(spark, label: str) -> str:
    """A database of its own below the shared folder, so runs never meet."""
    path = scratch(spark, label)
    name = catalog.database_name("dev", os.path.basename(path))
    return catalog.ensure_database(spark, name, path)


@query("a01_csv_scan", ALL_CUSTOMER)
def csv_scan(spark, sf):
    path = scratch(spark, "csv")
    files.write_files(table(spark, sf, "customer"), path, "csv")
    return files.read_files(spark, path, "csv", C.CUSTOMER)


@query(
    "a02_json_scan",
    "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events",
)
def json_scan(spark, sf):
    path = scratch(spark, "json")
    files.write_files(table(spark, sf, "events"), path, "json")
    rows = files.read_files(spark, path, "json", C.EVENTS)
    return rows.select("event_id", F.unix_micros("ts").alias("ts_us"), "user_id", "event_type", "value", "props")


@query(
    "a04_parquet_scan",
    "SELECT l_orderkey, l_partkey, CAST(l_suppkey AS INTEGER) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,"
    " l_extendedprice, l_returnflag FROM lineitem",
)
def parquet_scan(spark, sf):
    declared = [
        {"name": "l_orderkey", "type": "bigint"},
        {"name": "l_partkey", "type": "bigint"},
        {"name": "l_suppkey", "type": "int"},
        {"name": "l_linenumber", "type": "bigint"},
        {"name": "l_extendedprice", "type": "double"},
        {"name": "l_returnflag", "type": "string"},
    ]
    return files.read_files(spark, f"{sf}/lineitem.parquet", "parquet", declared)


@query(
    "a05_csv_write",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment"
    " FROM customer",
)
def csv_write(spark, sf):
    # The lines are taken apart as text; a number may be spelt in several ways, so it is compared as a number.
    path = scratch(spark, "csv-lines")
    customers = table(spark, sf, "customer")
    files.write_files(customers, path, "csv")
    lines = spark.read.text(path).where(~F.col("value").startswith("c_custkey,"))
    parts = {name: F.split("value", ",")[i] for i, name in enumerate(customers.columns)}
    return lines.select(*[(c.cast("double") if n == "c_acctbal" else c).alias(n) for n, c in parts.items()])


@query(
    "a06_json_write",
    "SELECT event_id, epoch_us(ts) AS ts_us, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_write(spark, sf):
    path = scratch(spark, "json-lines")
    files.write_files(table(spark, sf, "events"), path, "json")
    line = F.from_json("value", "event_id bigint, ts string, event_type string, value double, props string").alias("d")
    return spark.read.text(path).select(line).select(
        "d.event_id",
        F.unix_micros(F.col("d.ts").cast("timestamp")).alias("ts_us"),
        "d.event_type",
        "d.value",
        F.get_json_object("d.props", "$.k").cast("bigint").alias("k"),
    )


@query(
    "a08_parquet_write",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_linestatus, epoch_us(l_shipdate) AS ship_us FROM lineitem",
)
def parquet_write(spark, sf):
    path = scratch(spark, "parquet")
    files.write_files(table(spark, sf, "lineitem"), path, "parquet")
    rows = files.read_files(spark, path, "parquet", C.LINEITEM)
    return rows.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_quantity",
        "l_linestatus",
        F.unix_micros("l_shipdate").alias("ship_us"),
    )


def _avro_jar() -> bool:
    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    return bool(glob.glob(os.path.join(home, "jars", "spark-avro*.jar")))


def avro_scan(spark, sf):
    path = scratch(spark, "avro")
    files.write_files(table(spark, sf, "customer"), path, "avro")
    return files.read_files(spark, path, "avro", C.CUSTOMER)


if _avro_jar():
    query("a03_avro_scan", ALL_CUSTOMER)(avro_scan)
    query("a07_avro_write", ALL_CUSTOMER)(avro_scan)


@query(
    "a09_format_dispatch",
    "SELECT fmt, p_partkey, p_brand, p_retailprice FROM part,"
    " (SELECT unnest(['csv', 'json', 'parquet']) AS fmt) AS formats",
)
def format_dispatch(spark, sf):
    parts, out = table(spark, sf, "part"), None
    for fmt in ("csv", "json", "parquet"):
        path = scratch(spark, fmt)
        files.write_files(parts, path, fmt)
        rows = files.read_files(spark, path, fmt, C.PART).select(
            F.lit(fmt).alias("fmt"), "p_partkey", "p_brand", "p_retailprice"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "a10_run_landing",
    "SELECT 'run-all' AS run_id, o_orderkey, o_totalprice, true AS in_own_folder FROM orders"
    " UNION ALL SELECT 'run-open', o_orderkey, o_totalprice, true FROM orders WHERE o_orderstatus = 'O'",
)
def run_landing(spark, sf):
    base, orders = scratch(spark, "landing"), table(spark, sf, "orders")
    for run_id, rows in (("run-all", orders), ("run-open", orders.where("o_orderstatus = 'O'"))):
        files.land(rows, base, "sales", "orders", run_id, "parquet")
    landed = files.with_provenance(spark.read.parquet(files.landing_path(base, "sales", "orders")))
    return landed.select(
        "run_id",
        "o_orderkey",
        "o_totalprice",
        F.contains("file_path", F.concat(F.lit("/sales/orders/run_id="), "run_id", F.lit("/"))).alias("in_own_folder"),
    )


@query("a11_external_table", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def external_table(spark, sf):
    path = scratch(spark, "part-files")
    files.write_files(table(spark, sf, "part"), path, "csv")
    return catalog.register_external(spark, f"{_database(spark, 'catalog')}.part", "csv", path, C.PART)


@query(
    "a12_partition_split",
    "SELECT l_returnflag, l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R'",
)
def partition_split(spark, sf):
    path = scratch(spark, "lineitem-files")
    files.write_files(table(spark, sf, "lineitem"), path, "parquet", partition_by=["l_returnflag"])
    name = f"{_database(spark, 'split')}.lineitem"
    rows = catalog.register_external(spark, name, "parquet", path, C.LINEITEM, ["l_returnflag"])
    return rows.where("l_returnflag = 'R'").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")


@query(
    "a13_partition_discovery",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, 0 AS n_before FROM lineitem GROUP BY ALL",
)
def partition_discovery(spark, sf):
    path, name = scratch(spark, "discover-files"), f"{_database(spark, 'discover')}.lineitem"
    keys = ["l_returnflag", "l_linestatus"]
    spark.sql(
        f"CREATE TABLE {name} (l_orderkey bigint, l_returnflag string, l_linestatus string) USING parquet"
        f" PARTITIONED BY (l_returnflag, l_linestatus) LOCATION '{path}'"
    )
    files.write_files(table(spark, sf, "lineitem").select("l_orderkey", *keys), path, "parquet", partition_by=keys)
    before = spark.sql(f"SHOW PARTITIONS {name}").count()
    catalog.discover_partitions(spark, name)
    return spark.table(name).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(before).cast("int").alias("n_before"))


@query(
    "a14_create_database",
    "SELECT event_type, count(*) AS n, 'platform_dev_ops_events' AS formula FROM events GROUP BY event_type",
)
def create_database(spark, sf):
    name = _database(spark, "ops-events")
    catalog.ensure_database(spark, name)
    table(spark, sf, "events").select("event_type").write.saveAsTable(f"{name}.events")
    formula = catalog.database_name("dev", "ops-events")
    counted = spark.table(f"{name}.events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("formula", F.lit(formula))


@query("a15_acid_table", "SELECT event_id, user_id, event_type, value, 'run-1' AS run_id FROM events")
def acid_table(spark, sf):
    runs = RunTable(spark, f"{_database(spark, 'acid')}.events", C.EVENTS_RUN).create_if_missing()
    runs.create_if_missing().append(table(spark, sf, "events"), "run-1")
    return runs.rows("run-1")


@query("a16_warehouse_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def warehouse_table(spark, sf):
    name = f"{_database(spark, 'warehouse')}.orders"
    for _ in range(2):
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus VARCHAR(64),"
            " o_totalprice DOUBLE) USING parquet"
        )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    orders.write.insertInto(name)
    return spark.table(name).withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))


@query(
    "a17_insert_select",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'run-7' AS run_id FROM orders",
)
def insert_select(spark, sf):
    name = f"{_database(spark, 'insert')}.orders"
    runs = RunTable(spark, name, C.ORDERS_RUN).create_if_missing()
    fields = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
    spark.sql(
        f"INSERT INTO {name} SELECT {fields}, 'run-7' AS run_id FROM {{orders}} WHERE o_orderstatus = 'F'"
        f" UNION ALL SELECT {fields}, 'run-7' AS run_id FROM {{orders}} WHERE o_orderstatus <> 'F'",
        orders=table(spark, sf, "orders"),
    )
    return runs.rows("run-7")


@query(
    "a18_insert_values",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS meaning,"
    " 'run-2' AS run_id FROM orders",
)
def insert_values(spark, sf):
    name = f"{_database(spark, 'values')}.meanings"
    declared = [{"name": "code", "type": "string", "required": True}, {"name": "meaning", "type": "string"}]
    runs = RunTable(spark, name, declared).create_if_missing()
    spark.sql(
        f"INSERT INTO {name} VALUES ('F', 'finished', 'run-2'), ('O', 'open', 'run-2'), ('P', 'pending', 'run-2')"
    )
    orders = table(spark, sf, "orders")
    return orders.join(runs.rows("run-2"), orders["o_orderstatus"] == F.col("code")).select(
        "o_orderkey", "meaning", "run_id"
    )


@query(
    "a19_delete_run",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'run-' || o_orderstatus AS run_id FROM orders"
    " WHERE o_orderstatus <> 'F'",
)
def delete_run(spark, sf):
    orders = table(spark, sf, "orders")
    runs = RunTable(spark, f"{_database(spark, 'delete')}.orders", C.ORDERS_RUN).create_if_missing()
    for status in ("F", "O", "P"):
        runs.append(orders.where(F.col("o_orderstatus") == status), f"run-{status}")
    runs.delete("run-F")
    runs.delete("run-absent")
    return runs.rows()


@query(
    "a19_delete_in_shared_files",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'run-' || o_orderkey % 3 AS run_id FROM orders"
    " WHERE o_orderkey % 3 <> 1",
)
def delete_in_shared_files(spark, sf):
    # Three runs lie in common files; a delete keeps the others' rows in them.
    orders = table(spark, sf, "orders")
    runs = RunTable(spark, f"{_database(spark, 'shared')}.orders", C.ORDERS_RUN, shared_files=True).create_if_missing()
    runs.append_runs(orders, F.concat(F.lit("run-"), F.col("o_orderkey") % 3))
    runs.delete("run-1")
    runs.delete("run-absent")
    return runs.rows()


@query(
    "a20_cleanup",
    "SELECT o_orderstatus, count(*) AS n, 1 AS n_errors FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus",
)
def cleanup(spark, sf):
    base, orders = scratch(spark, "cleanup"), table(spark, sf, "orders")
    for status in ("F", "O", "P"):
        files.land(orders.where(F.col("o_orderstatus") == status), base, "sales", "orders", status, "parquet")
    gone = [files.landing_path(base, "sales", "orders", run) for run in ("F", "never-landed")]
    errors = [o for o in files.remove_paths(spark, gone) if not o["ok"]]
    left = spark.read.parquet(files.landing_path(base, "sales", "orders"))
    return left.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(errors)).cast("int").alias("n_errors")
    )


MODEL_SQL = "SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS largest FROM {orders} GROUP BY o_custkey"


@query("a21_model_table", MODEL_SQL.format(orders="orders"))
def model_table(spark, sf):
    name = f"{_database(spark, 'models')}.customer_orders"
    source = f"parquet.`{sf}/orders.parquet`"
    for _ in range(2):
        built = models.build(spark, name, MODEL_SQL.format(orders=source))
    return built


@query(
    "a22_teardown",
    "SELECT o_custkey, count(*) AS n_orders, false AS model_left FROM orders GROUP BY o_custkey",
)
def teardown(spark, sf):
    database = _database(spark, "teardown")
    kept = scratch(spark, "teardown-result")
    try:
        built = models.build(spark, f"{database}.m", MODEL_SQL.format(orders=f"parquet.`{sf}/orders.parquet`"))
        built.select("o_custkey", "n_orders").write.parquet(kept)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {database}.m")
    left = spark.catalog.tableExists(f"{database}.m")
    return spark.read.parquet(kept).withColumn("model_left", F.lit(left))


@query(
    "a23_seed_snapshot",
    """
    SELECT c_custkey, c_acctbal, '2024-01-01' AS valid_from,
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '2024-01-02' END AS valid_to
    FROM customer WHERE c_mktsegment <> 'FURNITURE'
    UNION ALL
    SELECT c_custkey, c_acctbal + 1, '2024-01-02', NULL FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT c_custkey, c_acctbal, '2024-01-02', NULL FROM customer WHERE c_mktsegment = 'FURNITURE'
    """,
)
def seed_snapshot(spark, sf):
    path = scratch(spark, "seed")
    files.write_files(table(spark, sf, "customer"), path, "csv")
    seeded = models.seed(spark, path, C.CUSTOMER, f"{_database(spark, 'seed')}.customer")
    segment = F.col("c_mktsegment")
    first = seeded.where(segment != "FURNITURE").select("c_custkey", "c_acctbal")
    raised = F.when(segment == "BUILDING", F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))
    second = seeded.where(segment != "MACHINERY").select("c_custkey", raised.alias("c_acctbal"))
    start = history.apply_snapshot(None, first, "c_custkey", "2024-01-01")
    return history.apply_snapshot(start, second, "c_custkey", "2024-01-02")


def event_records(events, partitions: int = 6):
    """Events as topic records: one topic per event type, keyed by user, offset by id."""
    topic = topics.topic_name("dev", F.lit("retail"), F.lit("web"), F.col("event_type"))
    return topics.as_records(events, F.col("user_id"), topic, F.col("event_id"), F.col("ts"), partitions)


@query(
    "a24_produce",
    "SELECT 'platform-dev.retail.web.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, event_id AS \"offset\","
    " event_id, value, props FROM events",
)
def produce(spark, sf):
    path = scratch(spark, "topic")
    topics.produce(event_records(table(spark, sf, "events")), path)
    sent = spark.read.schema(topics.RECORD).parquet(path)
    body = topics.decode(sent, "event_id bigint, value double, props string")
    return body.select("topic", "key", "offset", "body.event_id", "body.value", "body.props")


@query(
    "a25_positioned_read",
    """
    WITH bounds AS (SELECT max(event_id) // 2 AS middle FROM events)
    SELECT event_id AS "offset", CAST(user_id AS VARCHAR) AS key FROM events, bounds
    WHERE event_type = 'error' AND event_id >= middle
    """,
)
def positioned_read(spark, sf):
    path, events = scratch(spark, "positions"), table(spark, sf, "events")
    topics.produce(event_records(events), path)
    middle = F.floor(events.agg(F.max("event_id")).scalar() / 2)
    start = {partition: middle for partition in range(6)}
    return topics.read_from(spark, path, "platform-dev.retail.web.error", start).select("offset", "key")


# Where the readers of the partitions begin: all partitions but the last one are read.
STARTS = {0: 100, 1: 0, 2: 321, 3: 50, 4: 700}


@query(
    "a25_offset_source",
    f"""
    WITH starts(p, o) AS (VALUES {", ".join(f"({p}, {o})" for p, o in STARTS.items())})
    SELECT CAST(user_id % 6 AS INTEGER) AS "partition", event_id AS "offset", CAST(user_id AS VARCHAR) AS key, ts IS NOT NULL AS timed
    FROM events JOIN starts ON p = user_id % 6 AND event_id >= o WHERE event_type = 'error'
    """,
)
def offset_source(spark, sf):
    # Half of the log is there when the reader starts; it goes on from its checkpoint when the rest has come.
    path, out, events = scratch(spark, "log"), scratch(spark, "log-read"), table(spark, sf, "events")
    records = event_records(events).withColumn("partition", (F.col("key").cast("bigint") % 6).cast("int"))
    middle = events.agg(F.max("event_id")).scalar() / 2
    for half in (F.col("offset") <= middle, F.col("offset") > middle):
        record_log.append_log(records.where(half), path)
        stream = record_log.log_stream(spark, path, "platform-dev.retail.web.error", STARTS)
        read = streams.append_available(stream, out)
    return read.select("partition", "offset", "key", F.col("timestamp").isNotNull().alias("timed"))


@query(
    "a26_topic_to_table",
    "SELECT user_id, event_type AS event, event_id AS \"offset\", value FROM events",
)
def topic_to_table(spark, sf):
    schema = table(spark, sf, "events").schema
    records = event_records(streams.file_stream(spark, f"{sf}/events.parquet", schema))
    body = topics.decode(records, "user_id bigint, value double")
    raw = body.select(
        "body.user_id", topics.topic_parts(F.col("topic"))["event"].alias("event"), "offset", "body.value"
    )
    return streams.table_available(raw, f"{_database(spark, 'raw')}.retail_web", scratch(spark, "raw-checkpoint"))


@query(
    "a27_result_sink",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_returnflag",
)
def result_sink(spark, sf):
    result = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )
    written = spark.read.parquet(files.write_result(result, scratch(spark, "results"), "sales", "by_flag"))
    return written.withColumn("quantity", F.round("quantity", 6))


@query(
    "a28_metric_sink",
    "SELECT 'Shop' AS namespace, 'EventValue' AS metric, event_type, CAST(user_id AS VARCHAR) AS user_id, value,"
    " 'Count' AS unit, epoch_us(ts) AS ts_us FROM events",
)
def metric_datapoint_sink(spark, sf):
    path = scratch(spark, "metrics")
    dims = {"EventType": F.col("event_type"), "User": F.col("user_id")}
    events = table(spark, sf, "events")
    metric_sink.publish(metric_sink.as_datapoints(events, "Shop", "EventValue", F.col("value"), dims, F.col("ts")), path)
    return spark.read.parquet(path).select(
        "namespace",
        "metric",
        F.element_at("dims", F.lit("EventType")).alias("event_type"),
        F.element_at("dims", F.lit("User")).alias("user_id"),
        "value",
        "unit",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )


@query(
    "a29_result_documents",
    "SELECT doc_id AS run_id, CASE WHEN quality = 1 THEN 'PASS' ELSE 'FAIL' END AS status, 'quality' AS table_name,"
    " CASE WHEN toxic = 0 THEN 'SUCCESS' ELSE 'FAIL' END AS cleanup FROM labels",
)
def result_documents(spark, sf):
    path = scratch(spark, "documents")
    verdict = F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")
    tables = F.array(F.struct(F.lit("quality").alias("name"), verdict.alias("outcome"), F.lit("validate").alias("phase")))
    cleaned = F.struct(F.when(F.col("toxic") == 0, "SUCCESS").otherwise("FAIL").alias("outcome"))
    documents = table(spark, sf, "labels").select(
        F.col("doc_id").alias("run_id"), verdict.alias("status"), tables.alias("tables"), cleaned.alias("cleanup")
    )
    metric_sink.write_documents(documents, path)
    schema = (
        "run_id bigint, status string, tables array<struct<name:string,outcome:string,phase:string>>,"
        " cleanup struct<outcome:string>"
    )
    return spark.read.schema(schema).json(path).select(
        "run_id", "status", F.col("tables")[0]["name"].alias("table_name"), F.col("cleanup.outcome").alias("cleanup")
    )
