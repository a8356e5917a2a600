"""Integrity rules, each giving ``rule, key, detail``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import constraints as K
from tidewatch.operators import registrations
from tidewatch.queries.registry import query, table


@query(
    "l01_required",
    "SELECT 'required' AS rule, CAST(d.doc_id AS VARCHAR) AS key, 'quality, toxic' AS detail FROM documents d"
    " WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)",
)
def required(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return K.required(joined, "doc_id", ["lang", "quality", "toxic"])


@query(
    "l02_one_of",
    "SELECT 'one_of' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority AS detail FROM orders"
    " WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
)
def one_of(spark, sf):
    return K.one_of(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "l03_matches",
    "SELECT 'matches' AS rule, CAST(s_suppkey AS VARCHAR) AS key, s_name AS detail FROM supplier"
    " WHERE NOT regexp_matches(s_name, '^Supplier#[0-9]+[02468]$')",
)
def matches(spark, sf):
    return K.matches(table(spark, sf, "supplier"), "s_suppkey", "s_name", "^Supplier#[0-9]+[02468]$")


@query(
    "l04_max_length",
    """
    SELECT 'max_length' AS rule, CAST(p_partkey AS VARCHAR) AS key, d || ' has ' || length(d) AS detail
    FROM (SELECT p_partkey, 'platform-dev.' || p_brand || '.' || p_name || '.' || p_type AS d FROM part) WHERE length(d) > 42
    """,
)
def max_length(spark, sf):
    derived = F.concat_ws(".", F.lit("platform-dev"), "p_brand", "p_name", "p_type")
    return K.max_length(table(spark, sf, "part"), "p_partkey", derived, 42)


@query(
    "l05_in_range",
    "SELECT 'in_range' AS rule, l_orderkey || '/' || l_linenumber AS key, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0' AS detail"
    " FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 48",
)
def in_range(spark, sf):
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return K.in_range(table(spark, sf, "lineitem"), key, "l_quantity", 2, 48)


@query(
    "l06_unique",
    """
    WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING count(*) > 1)
    SELECT DISTINCT 'unique' AS rule, l_orderkey || '/' || l_linenumber AS key,
           l_orderkey || '/' || l_linenumber || ' (in ' || l_suppkey || ')' AS detail
    FROM lineitem JOIN d USING (l_orderkey, l_linenumber) WHERE l_linestatus = 'O'
    """,
)
def unique(spark, sf):
    return K.unique(
        table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey", active=F.col("l_linestatus") == "O"
    )


@query(
    "l07_references",
    """
    SELECT 'references' AS rule, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderkey AS VARCHAR) AS detail FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'references', CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """,
)
def references(spark, sf):
    orders = K.references(table(spark, sf, "orders"), "o_orderkey", "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")
    documents = K.references(table(spark, sf, "documents"), "doc_id", "doc_id", table(spark, sf, "labels"), "doc_id")
    return K.report(orders, documents)


@query(
    "l08_path_part",
    "SELECT 'equals_path_part' AS rule, CAST(page_id AS VARCHAR) AS key, 'https <> http' AS detail FROM pages"
    " WHERE starts_with(url, 'http:') OR regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) <> split_part(url, '/', 4)",
)
def path_part(spark, sf):
    pages = table(spark, sf, "pages")
    language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    by_scheme = K.equals_path_part(pages, "page_id", F.lit("https"), F.split_part("url", F.lit(":"), F.lit(1)))
    by_language = K.equals_path_part(pages, "page_id", language, F.split_part("url", F.lit("/"), F.lit(4)))
    return K.report(by_scheme, by_language)


@query(
    "l09_disjoint",
    """
    WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'F'),
    b AS (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O')
    SELECT 'disjoint' AS rule, CAST(o_custkey AS VARCHAR) AS key, string_agg(p, ', ' ORDER BY p) AS detail
    FROM a JOIN b USING (o_custkey, p) GROUP BY o_custkey
    """,
)
def disjoint(spark, sf):
    # Each list holds at most the five priorities.
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("retired"),
        F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("active"),
    )
    return K.disjoint(lists, "o_custkey", "retired", "active")


@query(
    "l09_disjoint_sets",
    """
    SELECT 'disjoint' AS rule, CAST(o_custkey AS VARCHAR) AS key, 'in both' AS detail FROM (
      SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
    """,
)
def disjoint_sets(spark, sf):
    orders = table(spark, sf, "orders")
    return K.disjoint_sets(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), "o_custkey")


@query(
    "l10_implies",
    "SELECT 'implies' AS rule, CAST(o_orderkey AS VARCHAR) AS key, 'urgent without finished order' AS detail FROM orders"
    " WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F'",
)
def implies(spark, sf):
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return K.implies(
        table(spark, sf, "orders"),
        "o_orderkey",
        F.col("o_orderpriority") == "1-URGENT",
        finished.isNotNull(),
        F.lit("urgent without finished order"),
    )


@query(
    "l11_known_kinds",
    """
    SELECT DISTINCT 'known_kinds' AS rule, event_type AS key, CAST(user_id AS VARCHAR) AS detail
    FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
    """,
)
def known_kinds(spark, sf):
    return K.known_kinds(table(spark, sf, "events"), "event_type", "user_id", ["click", "view", "purchase"])


@query(
    "l12_two_phase_retirement",
    "SELECT 'retired_before_removal' AS rule, CAST(c_custkey AS VARCHAR) AS key, 'removed without flag' AS detail FROM customer"
    " WHERE c_mktsegment = 'FURNITURE' AND c_acctbal >= 0",
)
def two_phase_retirement(spark, sf):
    customer = table(spark, sf, "customer")
    previous = customer.withColumn("retired", F.when(F.col("c_acctbal") < 0, True))
    return K.retired_before_removal(previous, customer.where("c_mktsegment <> 'FURNITURE'"), "c_custkey", "retired")


def _app_tables(spark, sf):
    """Orders are apps, their lines are events; urgent apps of customers with large orders are owned."""
    apps = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("app"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_own"),
        F.when(F.col("o_orderstatus") == "P", True).alias("retired"),
    )
    events = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("app"), "l_linenumber", "l_returnflag")
    owned = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_orderkey").alias("app"))
    return apps, events, owned


@query(
    "l13_active_children",
    """
    SELECT l_orderkey AS app, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus <> 'P' AND (o_orderpriority <> '5-LOW' OR o_totalprice > 250000) AND l_returnflag <> 'R'
    """,
)
def active_children(spark, sf):
    apps, events, owned = _app_tables(spark, sf)
    active = registrations.active_children(
        apps, events, owned, "app", "has_own", "retired", excluded=F.col("l_returnflag") == "R"
    )
    return active.select("app", "l_linenumber")


@query(
    "l13_own_role",
    "SELECT o_orderkey AS app FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_totalprice <= 250000",
)
def own_role(spark, sf):
    apps, _, owned = _app_tables(spark, sf)
    return registrations.needing_own_role(apps, owned, "app", "has_own", "retired").select("app")


@query(
    "l14_system_rows",
    """
    SELECT s_name || '-' || suffix AS topic, partitions, cleanup, retention_ms FROM supplier,
      (VALUES ('connect-configs', 1, 'compact', -1::BIGINT), ('connect-offsets', 25, 'compact', -1),
              ('connect-status', 5, 'compact,delete', 86400000), ('confluent-license', 1, 'compact', -1)) v(suffix, partitions, cleanup, retention_ms)
    WHERE suffix <> 'confluent-license' OR s_acctbal > 4000
    """,
)
def system_rows(spark, sf):
    variant = F.when(F.col("s_acctbal") > 4000, "confluent")
    rows = registrations.system_rows(table(spark, sf, "supplier").withColumn("variant", variant), "s_name", "variant")
    return rows.select("topic", "partitions", "cleanup", "retention_ms")


@query(
    "l15_fan_out",
    "SELECT 'fan_out' AS rule, CAST(o_custkey AS VARCHAR) AS key, 'warning: ' || count(*) || ' children' AS detail FROM orders"
    " GROUP BY o_custkey HAVING count(*) > 15",
)
def fan_out(spark, sf):
    return K.fan_out(table(spark, sf, "orders"), "o_custkey", 15)
