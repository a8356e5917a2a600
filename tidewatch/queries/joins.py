"""Joins over registrations, roles, tags and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import governance, history, registrations
from tidewatch.operators.closure import transitive_closure
from tidewatch.operators.grouping import children_counts, children_per_parent
from tidewatch.operators.verify import key_differences
from tidewatch.queries.registry import query, table
from tidewatch.streaming.metrics import batch_round_trips


@query(
    "c01_inner_join",
    "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def inner_join(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    return customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "c_name", "n_name")


@query(
    "c02_existence",
    "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey"
    " AND o_orderpriority = '1-URGENT' AND o_totalprice > 400000)",
)
def existence(spark, sf):
    large = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    customer = table(spark, sf, "customer")
    return customer.join(large, customer["c_custkey"] == large["o_custkey"], "left_semi").select("c_custkey")


@query(
    "c03_anti_join",
    "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def anti_join(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti").select("o_orderkey", "o_custkey")


@query(
    "c04_lookup_default",
    """
    WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey)
    SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN n ON o_custkey = c_custkey
    """,
)
def lookup_default(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 450000")
    counts = large.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return registrations.lookup_with_default(table(spark, sf, "customer").select("c_custkey"), counts, "c_custkey", "n", 0)


@query(
    "c05_keyed_product",
    "SELECT d.definition, d.definition || '-' || s_suppkey AS entry_key FROM supplier,"
    " (VALUES ('plaintext'), ('tls'), ('iam')) AS d(definition)",
)
def keyed_product(spark, sf):
    brokers = table(spark, sf, "supplier").select("s_suppkey")
    return registrations.keyed_product(brokers, ["plaintext", "tls", "iam"], "s_suppkey").select("definition", "entry_key")


@query(
    "c06_two_key_collect",
    """
    SELECT l_suppkey, o_orderpriority AS topic, count(*) AS n_rows FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = l_linestatus GROUP BY ALL
    """,
)
def two_key_collect(spark, sf):
    return supplier_topics(spark, sf)


@query(
    "c06_two_key_counts",
    """
    SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_children
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = l_linestatus GROUP BY l_suppkey
    """,
)
def two_key_counts(spark, sf):
    return children_counts(supplier_topics(spark, sf), ["l_suppkey"])


def supplier_topics(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("s"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), "o_orderpriority"
    )
    joined = lines.join(orders, ["k", "s"]).withColumnRenamed("o_orderpriority", "topic")
    return children_per_parent(joined, ["l_suppkey"], "topic")


EXPRESSION_SQL = (
    "'brand=Brand#' || (s_suppkey % 25 + 1) || ';size=' || array_to_string(list_sort(list_distinct("
    "[CAST(s_nationkey + 1 AS VARCHAR), CAST(s_nationkey + 20 AS VARCHAR)])), '|')"
)


def tag_expressions(spark, sf):
    """One grant per supplier: its account decides the brand and size asked for."""
    suppliers = table(spark, sf, "supplier")
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string"))
    sizes = F.array((F.col("s_nationkey") + 1).cast("string"), (F.col("s_nationkey") + 20).cast("string"))
    by_brand = suppliers.select(F.col("s_suppkey").alias("grant_id"), F.lit("brand").alias("key"), F.array(brand).alias("values"))
    by_size = suppliers.select(F.col("s_suppkey").alias("grant_id"), F.lit("size").alias("key"), sizes.alias("values"))
    return by_brand.unionByName(by_size)


def part_tags(spark, sf):
    tags = F.array(
        F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")),
        F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
        F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("resource"), F.inline(tags))


@query(
    "c07_tag_expression",
    f"SELECT DISTINCT {EXPRESSION_SQL} AS expression, p_partkey AS resource FROM supplier JOIN part"
    " ON p_brand = 'Brand#' || (s_suppkey % 25 + 1) AND p_size IN (s_nationkey + 1, s_nationkey + 20)",
)
def tag_expression(spark, sf):
    classes = governance.expression_classes(tag_expressions(spark, sf))
    return governance.match_expressions(classes, part_tags(spark, sf))


@query("c07_expression_members", f"SELECT s_suppkey AS grant_id, {EXPRESSION_SQL} AS expression FROM supplier")
def expression_members(spark, sf):
    return governance.expression_classes(tag_expressions(spark, sf)).select("grant_id", "expression")


@query(
    "c08_inherited_tags",
    """
    SELECT p_partkey AS resource, 'type' AS key, CASE WHEN p_size > 40 THEN p_type ELSE 'from ' || p_brand END AS value FROM part
    UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 40
    """,
)
def inherited_tags(spark, sf):
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "resource")
    tables = parts.select("resource", F.col("p_brand").alias("database"))
    own_tags = F.array(
        F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")),
        F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")),
    )
    own = parts.where("p_size > 40").select("resource", F.inline(own_tags))
    database = parts.select(F.col("p_brand").alias("database")).distinct().select(
        "database", F.lit("type").alias("key"), F.concat(F.lit("from "), F.col("database")).alias("value")
    )
    return governance.inherit_tags(tables, own, database)


@query(
    "c09_row_comparison",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'missing'
                            ELSE 'changed' END AS status
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL
    SELECT -1 - o_orderkey, 'extra' FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P'
    """,
)
def row_comparison(spark, sf):
    expected = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    kept = expected.where(~(urgent & (F.col("o_orderstatus") == "F"))).withColumn(
        "o_totalprice", F.when(urgent, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    added = expected.where("o_orderpriority = '5-LOW' AND o_orderstatus = 'P'").withColumn(
        "o_orderkey", -1 - F.col("o_orderkey")
    )
    return key_differences(expected, kept.unionByName(added), ["o_orderkey"]).select("o_orderkey", "status")


@query(
    "c10_drift",
    """
    SELECT c_custkey, 'removed' AS status, '' AS changed_columns FROM customer WHERE c_mktsegment = 'FURNITURE'
    UNION ALL
    SELECT c_custkey, 'changed', CASE WHEN c_nationkey = 3 THEN 'c_acctbal,c_mktsegment' ELSE 'c_mktsegment' END
    FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL
    SELECT -1 - c_custkey, 'added', '' FROM customer WHERE c_mktsegment = 'MACHINERY'
    """,
)
def drift(spark, sf):
    declared = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    building = F.col("c_mktsegment") == "BUILDING"
    moved = building & (F.col("c_nationkey") == 3)
    changed = declared.where("c_mktsegment <> 'FURNITURE'").select(
        "c_custkey",
        "c_nationkey",
        F.when(moved, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(building, "OFFICE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    added = declared.where("c_mktsegment = 'MACHINERY'").withColumn("c_custkey", -1 - F.col("c_custkey"))
    return history.drift(declared, changed.unionByName(added), "c_custkey")


@query(
    "c11_role_closure",
    """
    WITH RECURSIVE edges AS (SELECT c_custkey // 4 AS parent, c_custkey AS child FROM customer WHERE c_custkey > 0),
    reach(parent, child, depth) AS (
      SELECT parent, child, 1 FROM edges
      UNION ALL
      SELECT r.parent, e.child, r.depth + 1 FROM reach r JOIN edges e ON r.child = e.parent)
    SELECT parent, child, depth FROM reach
    """,
)
def role_closure(spark, sf):
    edges = table(spark, sf, "customer").where("c_custkey > 0").select(
        F.floor(F.col("c_custkey") / 4).cast("bigint").alias("parent"), F.col("c_custkey").alias("child")
    )
    return transitive_closure(edges, "parent", "child")


@query(
    "c12_round_trip_match",
    """
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN 'fail' ELSE 'pass' END AS status,
           CASE event_type WHEN 'click' THEN 35000000 WHEN 'purchase' THEN 5000000 WHEN 'signup' THEN 0 END AS waited_us
    FROM events
    """,
)
def round_trip_match(spark, sf):
    # Errors are never received, views one second too late, clicks just in time.
    sent = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    delay = F.when(F.col("event_type") == "click", 35).when(F.col("event_type") == "view", 36)
    delay = delay.when(F.col("event_type") == "purchase", 5).otherwise(0)
    received = sent.where("event_type <> 'error'").withColumn("ts", F.col("ts") + F.make_interval(secs=delay))
    matched = batch_round_trips(sent, received, "event_id")
    waited = (F.unix_micros("received_at") - F.unix_micros("sent_at")).cast("int")
    return matched.select("event_id", "status", waited.alias("waited_us"))


@query(
    "c13_credential_scope",
    """
    WITH w AS (
      SELECT DISTINCT c_custkey AS namespace, unnest(['base', 'db' || (c_nationkey % 7), 'db' || (c_nationkey % 5)]) AS d
      FROM customer)
    SELECT namespace, string_agg(d, ',' ORDER BY d) AS databases FROM w GROUP BY namespace
    """,
)
def credential_scope(spark, sf):
    writable = F.array(*[F.concat(F.lit("db"), (F.col("c_nationkey") % m).cast("string")) for m in (7, 5)])
    namespaces = table(spark, sf, "customer").select(F.col("c_custkey").alias("namespace"), writable.alias("write_databases"))
    return governance.credential_databases(namespaces, "base").withColumn("databases", F.array_join("databases", ","))
