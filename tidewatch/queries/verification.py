"""Reconciliation, round-trip suites and model runs."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidewatch.operators import governance
from tidewatch.operators.verify import must_be_empty, symmetric_difference, validate
from tidewatch.plans import models, suites
from tidewatch.queries import columns as C
from tidewatch.queries.registry import query, table
from tidewatch.queries.sources import MODEL_SQL, _avro_jar, _database
from tidewatch.session import scratch


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "j01_validate",
    """
    WITH e AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders),
    worst AS (SELECT * FROM e WHERE o_totalprice = (SELECT max(o_totalprice) FROM e) ORDER BY o_orderkey LIMIT 1)
    SELECT 'same' AS variant, true AS ok, NULL AS detail FROM e HAVING count(*) > 0
    UNION ALL
    SELECT 'short', false, 'Row count mismatch: expected ' || count(*) || ', got ' || count(*) FILTER (WHERE o_orderstatus <> 'F') FROM e
    UNION ALL
    SELECT 'renamed', false, 'Column mismatch: expected [''o_orderkey'', ''o_orderstatus'', ''o_totalprice''], got [''o_orderkey'', ''o_totalprice'', ''state'']'
    FROM e HAVING count(*) > 0
    UNION ALL
    SELECT 'damaged', false, 'Row ' || (SELECT count(*) FROM e WHERE e.o_orderkey < w.o_orderkey) || ' mismatch: expected {"o_orderkey":'
           || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}, got {"o_orderkey":' || o_orderkey || ',"o_orderstatus":"X"}'
    FROM worst w
    UNION ALL
    SELECT 'text', false, 'Failed to coerce results: ' || count(*) FILTER (WHERE o_orderstatus = 'P') || ' rows' FROM e
    """,
)
def validation(spark, sf):
    expected = _orders(spark, sf)
    worst = expected.agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))).scalar()
    status = F.when(F.col("o_orderkey") == worst, "X").otherwise(F.col("o_orderstatus"))
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    pair = expected.select("o_orderkey", "o_orderstatus")
    variants = {
        "same": (expected, expected),
        "short": (expected, expected.where("o_orderstatus <> 'F'")),
        "renamed": (expected, expected.withColumnRenamed("o_orderstatus", "state")),
        "damaged": (pair, pair.withColumn("o_orderstatus", status)),
        "text": (expected, expected.withColumn("o_totalprice", text)),
    }
    out = None
    for name, (wanted, found) in variants.items():
        verdict = validate(wanted, found, "o_orderkey").select(F.lit(name).alias("variant"), "ok", "detail")
        out = verdict if out is None else out.unionByName(verdict)
    return out


@query(
    "j01_missing_keys",
    """
    WITH e AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS k, o_orderstatus, o_totalprice FROM orders),
    f AS (SELECT min(k) AS k FROM e)
    SELECT 'same' AS variant, count(*) FILTER (WHERE k IS NULL) > 0 AS ok, NULL AS detail FROM e
    UNION ALL SELECT 'changed', count(*) FILTER (WHERE k IS NULL) = 0, 'Row 0 mismatch' FROM e
    UNION ALL SELECT 'changed, tolerant', count(*) FILTER (WHERE k IS NULL) = 0, 'Row 0 mismatch' FROM e
    UNION ALL SELECT 'later', false, 'Row ' || count(*) || ' mismatch' FROM e WHERE k IS NULL
    """,
)
def missing_keys(spark, sf):
    # Every fifth order has lost its key; the rows without a key count as those of one key.
    orders = _orders(spark, sf)
    expected = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")))
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    changed = expected.withColumn("o_totalprice", F.when(key.isNull(), price + 1).otherwise(price))
    first = expected.agg(F.min("o_orderkey")).scalar()
    later = expected.withColumn("o_totalprice", F.when(key == first, price + 1).otherwise(price))
    variants = {"same": (expected, None), "changed": (changed, None), "changed, tolerant": (changed, 0.5), "later": (later, None)}
    out = None
    for name, (found, tolerance) in variants.items():
        verdict = validate(expected, found, "o_orderkey", tolerance=tolerance)
        row = verdict.select(F.lit(name).alias("variant"), "ok", F.regexp_extract("detail", "^Row [0-9]+ mismatch", 0).alias("detail"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "j02_validate_values",
    "SELECT count(*) > 0 AS ok, CAST(NULL AS VARCHAR) AS detail FROM orders",
)
def value_validation(spark, sf):
    expected = _orders(spark, sf)
    return validate(expected, expected.withColumn("loaded_by", F.lit("job")), "o_orderkey", check_columns=False)


@query(
    "j02_damaged_copy",
    """
    WITH e AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), k AS (SELECT max(o_orderkey) AS last FROM e),
    v AS (SELECT (SELECT count(*) FROM e WHERE o_orderkey < last) AS n, last FROM k)
    SELECT false AS ok, 'Row ' || n || ' mismatch' AS detail FROM v
    """,
)
def damaged_copy(spark, sf):
    # The status of the last order is lost on the way; other columns don't matter to this check.
    expected = _orders(spark, sf)
    last = expected.agg(F.max("o_orderkey")).scalar()
    damaged = expected.withColumn("o_orderstatus", F.when(F.col("o_orderkey") != last, F.col("o_orderstatus")))
    found = validate(expected, damaged.withColumn("loaded_by", F.lit("job")), "o_orderkey", check_columns=False)
    return found.select("ok", F.regexp_extract("detail", "^Row [0-9]+ mismatch", 0).alias("detail"))


@query(
    "j03_format_round_trip",
    """
    SELECT name, 'PASS' AS outcome, 'validate' AS phase FROM (SELECT unnest(['e2e_csv', 'e2e_json', 'e2e_parquet']) AS name)
    WHERE (SELECT count(*) FROM customer) > 0
    UNION ALL SELECT 'e2e_avro', __AVRO__ FROM customer HAVING count(*) > 0
    UNION ALL SELECT 'cleanup', 'SUCCESS', 'cleanup' FROM customer HAVING count(*) > 0
    """.replace("__AVRO__", "'PASS', 'validate'" if _avro_jar() else "'SKIPPED', 'write'"),
)
def format_round_trip(spark, sf):
    # Avro needs a module of its own; without it its row says SKIPPED.
    suite = suites.format_round_trip(
        table(spark, sf, "customer"), C.CUSTOMER, "c_custkey", scratch(spark, "round-trip"), "run-1"
    )
    return suite.select("name", "outcome", "phase")


@query(
    "j03_damaged_formats",
    """
    WITH k AS (SELECT min(c_custkey) AS first, max(c_custkey) AS last, count(*) AS n FROM customer)
    SELECT 'e2e_csv' AS name, 'FAIL' AS outcome, 'validate' AS phase, 'Row count mismatch: expected ' || n || ', got ' || (n - 1) AS detail FROM k
    UNION ALL SELECT 'e2e_parquet', 'FAIL', 'validate', 'Row count mismatch: expected ' || n || ', got ' || (n - 1) FROM k
    UNION ALL SELECT 'cleanup', 'SUCCESS', 'cleanup', NULL FROM k
    """,
)
def damaged_formats(spark, sf):
    # One row gets lost on the way back.
    customer = table(spark, sf, "customer")
    last = customer.agg(F.max("c_custkey")).scalar()
    return suites.format_round_trip(
        customer, C.CUSTOMER, "c_custkey", scratch(spark, "damaged"), "run-1", ("csv", "parquet"), lambda rows: rows.where(F.col("c_custkey") < last)
    )


@query(
    "j04_damaged_run_table",
    """
    WITH k AS (SELECT max(event_id) AS last FROM events)
    SELECT 'run-1' AS run_id, 'FAIL' AS status, 'validate' AS phase, 'Row ' || (SELECT count(*) FROM events WHERE event_id < last) || ' mismatch' AS detail,
           'SUCCESS' AS cleanup FROM k
    """,
)
def damaged_run_table(spark, sf):
    # The user of the last event gets lost on the way back.
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    last = events.agg(F.max("event_id")).scalar()
    lose = lambda rows: rows.withColumn("user_id", F.when(F.col("event_id") < last, F.col("user_id")))
    name = f"{_database(spark, 'damaged')}.events"
    found = suites.run_table_round_trip(events, C.EVENTS_RUN, "event_id", name, "run-1", lose)
    return found.withColumn("detail", F.regexp_extract("detail", "^Row [0-9]+ mismatch", 0))


@query(
    "j04_run_table_round_trip",
    "SELECT 'run-1' AS run_id, 'PASS' AS status, 'validate' AS phase, CAST(NULL AS VARCHAR) AS detail, 'SUCCESS' AS cleanup"
    " FROM events HAVING count(*) > 0",
)
def run_table_round_trip(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    name = f"{_database(spark, 'suite')}.events"
    return suites.run_table_round_trip(events, C.EVENTS_RUN, "event_id", name, "run-1")


def part_access(spark, sf):
    """Asked rights: a supplier reads the parts of its tag expression; large accounts also write them."""
    from tidewatch.queries.joins import part_tags, tag_expressions

    asked = _asked(spark, sf).withColumnRenamed("principal", "grant_id")
    matched = governance.match_asked(asked, tag_expressions(spark, sf), part_tags(spark, sf))
    writers = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("grant_id"))
    reads = matched.withColumn("permission", F.lit("SELECT"))
    writes = matched.join(writers, "grant_id", "left_semi").withColumn("permission", F.lit("INSERT"))
    rows = reads.unionByName(writes).withColumnRenamed("grant_id", "principal")
    return governance.effective_permissions(rows.withColumn("mechanism", F.lit("lf_tag")))


MATCHED_SQL = (
    "FROM supplier JOIN part ON p_brand = 'Brand#' || (s_suppkey % 25 + 1) AND p_size IN (s_nationkey + 1, s_nationkey + 20)"
)
ASKED_SQL = "SELECT l_suppkey AS principal, l_partkey AS resource FROM lineitem GROUP BY ALL"


@query(
    "j05_positive_check",
    f"""
    WITH asked AS ({ASKED_SQL}), held AS (SELECT s_suppkey, p_partkey {MATCHED_SQL})
    SELECT principal, resource, CASE WHEN s_suppkey IS NULL THEN 'FAIL' ELSE 'PASS' END AS outcome
    FROM asked LEFT JOIN held ON s_suppkey = principal AND p_partkey = resource
    """,
)
def positive_check(spark, sf):
    return governance.positive_check(part_access(spark, sf), _asked(spark, sf))


@query(
    "j06_negative_check",
    f"""
    WITH asked AS ({ASKED_SQL}), held AS (SELECT s_suppkey, p_partkey {MATCHED_SQL} WHERE s_acctbal > 5000)
    SELECT principal, resource, CASE WHEN s_suppkey IS NULL THEN 'PASS' ELSE 'FAIL' END AS outcome,
           CASE WHEN s_suppkey IS NULL THEN '' ELSE 'over-permissioned' END AS detail
    FROM asked LEFT JOIN held ON s_suppkey = principal AND p_partkey = resource
    """,
)
def negative_check(spark, sf):
    return governance.negative_check(part_access(spark, sf), _asked(spark, sf))


def _asked(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("principal"), F.col("l_partkey").alias("resource")
    ).distinct()


def label_checks(spark, sf):
    """Labels as access checks: service and mechanism from the id, the reason from the label."""
    service = F.when(F.col("doc_id") % 3 == 0, "Redshift").otherwise("S3Tables")
    mechanism = F.when(F.col("doc_id") % 2 == 0, "lf_tag").otherwise("resource_permission")
    reason = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, F.lit("timeout"))).otherwise(
        "Access Denied by policy"
    )
    return table(spark, sf, "labels").select("doc_id", service.alias("service"), mechanism.alias("mechanism"), reason.alias("reason"))


CHECKS_SQL = """
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Redshift' ELSE 'S3Tables' END AS service,
         CASE WHEN doc_id % 2 = 0 THEN 'LfTag' ELSE 'ResourcePermission' END AS mechanism,
         CASE WHEN toxic = 1 AND quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'INCONCLUSIVE' ELSE 'FAIL' END
              WHEN toxic = 1 THEN 'FAIL' ELSE 'PASS' END AS outcome
  FROM labels
"""


@query("j07_tri_state_outcome", f"SELECT doc_id, service, outcome FROM ({CHECKS_SQL})")
def tri_state_outcome(spark, sf):
    outcome = suites.negative_outcome(F.col("service"), F.col("reason"))
    return label_checks(spark, sf).select("doc_id", "service", outcome.alias("outcome"))


@query(
    "j08_check_matrix",
    f"""
    WITH c AS ({CHECKS_SQL}), m AS (
      SELECT s.service, k.mechanism FROM (SELECT unnest(['S3Tables', 'Redshift']) AS service) s,
             (SELECT unnest(['LfTag', 'ResourcePermission']) AS mechanism) k)
    SELECT m.service || m.mechanism || 'NegativeCheckSuccess' AS metric,
           coalesce(min(CASE WHEN outcome IN ('PASS', 'INCONCLUSIVE') THEN 1 ELSE 0 END), 0)::INTEGER AS value
    FROM m LEFT JOIN c USING (service, mechanism) GROUP BY m.service, m.mechanism
    UNION ALL SELECT service || mechanism || 'PositiveCheckSuccess', 0 FROM m
    UNION ALL SELECT service || 'CleanupSuccess', min(CASE WHEN outcome = 'FAIL' THEN 0 ELSE 1 END)::INTEGER FROM c GROUP BY service
    """,
)
def check_matrix(spark, sf):
    checks = label_checks(spark, sf).select(
        "service",
        "mechanism",
        F.lit("negative").alias("polarity"),
        suites.negative_outcome(F.col("service"), F.col("reason")).alias("outcome"),
    )
    cleaned = F.when(F.col("outcome") == "FAIL", "FAIL").otherwise("SUCCESS")
    return suites.check_metrics(checks, checks.select("service", cleaned.alias("outcome")))


@query(
    "j09_suite_roll_up",
    """
    SELECT source, count(*) AS n_checks, count(*) FILTER (WHERE quality = 0) AS n_failing,
           CASE WHEN count(*) FILTER (WHERE quality = 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
    FROM labels JOIN documents USING (doc_id) GROUP BY source
    """,
)
def suite_roll_up(spark, sf):
    return suites.roll_up(source_outcomes(spark, sf), ["source"])


@query(
    "j09_failing_items",
    """
    SELECT source, doc_id, count(*) AS n_rows FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY ALL
    """,
)
def failing_items(spark, sf):
    return suites.failing_items(source_outcomes(spark, sf), ["source"], "doc_id")


def source_outcomes(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "source")
    checks = table(spark, sf, "labels").join(documents, "doc_id")
    return checks.withColumn("outcome", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL"))


@query(
    "j10_run_summary",
    """
    WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS failing FROM orders)
    SELECT o_custkey, count(*) AS n_nodes, count(*) FILTER (WHERE failing) AS n_failing,
           count(*) FILTER (WHERE failing) = 0 AS success
    FROM n GROUP BY o_custkey
    """,
)
def run_summary(spark, sf):
    return models.run_summary(order_nodes(spark, sf), ["o_custkey"])


@query(
    "j10_failing_nodes",
    "SELECT o_custkey, 'model.' || o_orderkey AS unique_id, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL",
)
def failing_nodes(spark, sf):
    return models.failing_nodes(order_nodes(spark, sf), ["o_custkey"])


def order_nodes(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "error").otherwise("success")
    return table(spark, sf, "orders").select(
        "o_custkey", F.concat(F.lit("model."), F.col("o_orderkey").cast("string")).alias("unique_id"), status.alias("status")
    )


@query(
    "j11_assertion",
    """
    SELECT 'orders_have_lines' AS name, count(*) AS failures, count(*) = 0 AS passed FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'lines_have_orders', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'orders_equal_themselves', 0, true FROM orders HAVING count(*) > 0
    """,
)
def assertion(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    same = orders["o_orderkey"] == lines["l_orderkey"]
    fields = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    tests = [
        must_be_empty(orders.join(lines, same, "left_anti"), "orders_have_lines"),
        must_be_empty(lines.join(orders, same, "left_anti"), "lines_have_orders"),
        must_be_empty(symmetric_difference(orders.select(*fields), orders.select(*fields)), "orders_equal_themselves"),
    ]
    return tests[0].unionByName(tests[1]).unionByName(tests[2])


@query(
    "j12_seed_build_test",
    """
    SELECT 'model.customer_orders' AS unique_id, 'success' AS status, NULL AS message FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'model.big_customers', 'success', NULL FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'test.no_lost_customers', 'pass', NULL FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'test.nobody_is_big', 'fail', count(*) || ' rows' FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) > 499000)
    UNION ALL SELECT 'left_over_tables', '0', NULL FROM orders HAVING count(*) > 0
    """,
)
def seed_build_test(spark, sf):
    path = scratch(spark, "models")
    database = f"platform_dev_{os.path.basename(path).replace('-', '_')}"
    source = f"parquet.`{sf}/orders.parquet`"
    nodes = models.run_models(
        spark,
        database,
        [
            ("customer_orders", MODEL_SQL.format(orders=source)),
            ("big_customers", f"SELECT * FROM {database}.customer_orders WHERE largest > 499000"),
        ],
        [
            (
                "no_lost_customers",
                f"SELECT o_custkey FROM {source} EXCEPT SELECT o_custkey FROM {database}.customer_orders",
            ),
            ("nobody_is_big", f"SELECT * FROM {database}.big_customers"),
        ],
        location=path,
    )
    left = spark.sql(f"SHOW TABLES IN {database}").agg(F.count(F.lit(1)).cast("string").alias("status"))
    leftover = left.select(F.lit("left_over_tables").alias("unique_id"), "status", F.lit(None).cast("string").alias("message"))
    return nodes.select("unique_id", "status", "message").unionByName(leftover)
