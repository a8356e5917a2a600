"""Projections, filters and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import predicates as P
from tidewatch.functions.schema import apply_schema
from tidewatch.operators import logs
from tidewatch.operators.metrics import period_start
from tidewatch.queries.registry import query, table
from tidewatch.session import literal_rows
from tidewatch.sources.topics import decode


@query("b01_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def projection(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("b02_equality_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def equality_filter(spark, sf):
    return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")


@query("b03_in_list", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (1, 2, 3)")
def in_list(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey", "c_nationkey")


@query(
    "b04_literal_relation",
    "SELECT o_orderkey, label, rank FROM orders JOIN (VALUES ('1-URGENT', 'now', 1), ('2-HIGH', 'soon', 2))"
    " AS v(priority, label, rank) ON o_orderpriority = v.priority",
)
def literal_relation(spark, sf):
    labels = literal_rows(
        spark, [("1-URGENT", "now", 1), ("2-HIGH", "soon", 2)], "o_orderpriority string, label string, rank int"
    )
    return table(spark, sf, "orders").join(labels, "o_orderpriority").select("o_orderkey", "label", "rank")


@query(
    "b05_typed_coercion",
    """
    WITH raw AS (
      SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'x' ELSE '' END || c_custkey AS id, c_name AS name,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE CAST(c_acctbal AS VARCHAR) END AS value,
             CASE c_mktsegment WHEN 'BUILDING' THEN 'True' WHEN 'MACHINERY' THEN '1'
                  WHEN 'FURNITURE' THEN 'yes' ELSE 'false' END AS active
      FROM customer)
    SELECT TRY_CAST(id AS INTEGER) AS id, name, TRY_CAST(value AS DOUBLE) AS value,
           lower(active) IN ('true', '1') AS active
    FROM raw
    """,
)
def typed_coercion(spark, sf):
    segment = F.col("c_mktsegment")
    raw = table(spark, sf, "customer").select(
        F.concat(F.when(segment == "FURNITURE", "x").otherwise(""), F.col("c_custkey").cast("string")).alias("id"),
        F.col("c_name").alias("name"),
        F.when(segment == "MACHINERY", "").otherwise(F.col("c_acctbal").cast("string")).alias("value"),
        F.when(segment == "BUILDING", "True")
        .when(segment == "MACHINERY", "1")
        .when(segment == "FURNITURE", "yes")
        .otherwise("false")
        .alias("active"),
    )
    declared = [("id", "int"), ("name", "string"), ("value", "double"), ("active", "boolean")]
    return apply_schema(raw, [{"name": n, "type": t} for n, t in declared])


@query("b06_cast_double", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(p_retailprice AS INTEGER) AS price FROM part")
def cast_double(spark, sf):
    # DuckDB rounds a double to the nearest integer, Spark cuts it off.
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("size"), F.rint("p_retailprice").cast("int").alias("price")
    )


@query("b07_message_filter", "SELECT event_id FROM events WHERE event_type <> 'view' AND CAST(json_extract(props, '$.k') AS INTEGER) = 9")
def message_filter(spark, sf):
    # Views carry a cut-off document, which is skipped rather than an error.
    value = F.when(F.col("event_type") == "view", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    records = table(spark, sf, "events").select("event_id", value.alias("value"))
    return decode(records, "k int").where("body.k = 9").select("event_id")


@query(
    "b08_log_terms",
    """
    SELECT source, t.term, count(*) FILTER (WHERE contains(text, t.term)) AS n
    FROM documents, (VALUES ('license'), ('License'), ('@')) AS t(term) GROUP BY source, t.term
    """,
)
def log_terms(spark, sf):
    return logs.term_counts(table(spark, sf, "documents"), "text", ("license", "License", "@"), ["source"])


@query(
    "b09_denial_classifier",
    "SELECT doc_id, coalesce(contains(lower(text), 'license') OR contains(lower(text), '@'), false) AS marked FROM documents",
)
def denial_classifier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.contains_any(F.col("text"), ("license", "@")).alias("marked"))


@query(
    "b10_nested_projection",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS redshift_status FROM events WHERE event_type <> 'click'",
)
def nested_projection(spark, sf):
    # Clicks have no such section in their document.
    body = F.when(
        F.col("event_type") != "click", F.concat(F.lit('{"redshift": {"status": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    ).otherwise("{}")
    documents = table(spark, sf, "events").select("event_id", body.alias("document"))
    schema = "redshift struct<status:int>"
    return logs.nested_fields(documents, "document", schema, {"redshift_status": "redshift.status"}, "redshift.status")


def with_dims(events):
    """Errors are reported per user as well; the other types per type only."""
    kind = [F.lit("EventType"), F.col("event_type")]
    both = F.create_map(*kind, F.lit("User"), F.col("user_id").cast("string"))
    return events.withColumn("dims", F.when(F.col("event_type") == "error", both).otherwise(F.create_map(*kind)))


@query("b11_exact_dimensions", "SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def exact_dimensions(spark, sf):
    points = with_dims(table(spark, sf, "events"))
    purchases = P.has_exact_dims(F.col("dims"), ["EventType"], EventType="purchase")
    return points.where(purchases).select("event_id", "value")


@query(
    "b12_free_term",
    "SELECT event_id FROM events WHERE contains(event_type, 'rr') OR (event_type = 'error' AND contains(CAST(user_id AS VARCHAR), 'rr'))"
    " OR contains(event_type, 'ie')",
)
def free_term(spark, sf):
    points = with_dims(table(spark, sf, "events"))
    found = P.any_dim_contains(F.col("dims"), "rr") | P.any_dim_contains(F.col("dims"), "ie")
    return points.where(found).select("event_id")


@query(
    "b13_include_exclude",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^(red|blue) ') AND NOT regexp_matches(p_name, 'bolt$')",
)
def include_exclude(spark, sf):
    return table(spark, sf, "part").where(P.include_exclude(F.col("p_name"), "^(red|blue) ", "bolt$")).select(
        "p_partkey", "p_name"
    )


@query(
    "b14_environment_filter",
    """
    SELECT event_id FROM events
    WHERE event_type = 'view' OR (event_type IN ('click', 'error'))
    """,
)
def environment_filter(spark, sf):
    # Views list no environment, clicks and errors list test, the rest prod.
    lists = F.when(F.col("event_type").isin("click", "error"), F.array(F.lit("dev"), F.lit("test"))).when(
        F.col("event_type") != "view", F.array(F.lit("prod"))
    )
    return table(spark, sf, "events").where(P.in_environment(lists, "test")).select("event_id")


@query("b15_active_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def active_filter(spark, sf):
    retired = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return table(spark, sf, "orders").where(P.is_active(retired)).select("o_orderkey")


@query(
    "b16_exclude_children",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber NOT IN (2, 5)",
)
def exclude_children(spark, sf):
    excluded = F.when(F.col("l_returnflag") == "R", F.array(F.lit(2), F.lit(5)))
    return table(spark, sf, "lineitem").where(P.not_listed(F.col("l_linenumber"), excluded)).select(
        "l_orderkey", "l_linenumber"
    )


@query(
    "b17_exactly_one",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_orderpriority = '1-URGENT')",
)
def exactly_one(spark, sf):
    role = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))
    subject = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey"))
    return table(spark, sf, "orders").where(P.exactly_one(role, subject)).select("o_orderkey")


@query(
    "b18_guarded_ratio",
    """
    WITH c AS (
      SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS period_start,
             count(*) FILTER (WHERE event_type = 'error') AS f, count(*) FILTER (WHERE event_type <> 'error') AS s
      FROM events GROUP BY ALL)
    SELECT user_id, period_start, CASE WHEN f + s >= 4 THEN f / (f + s) ELSE 0.0 END AS ratio FROM c
    """,
)
def guarded_ratio(spark, sf):
    failed = F.col("event_type") == "error"
    counts = table(spark, sf, "events").groupBy("user_id", period_start(F.col("ts"), 86400).alias("period_start")).agg(
        F.count_if(failed).alias("f"), F.count_if(~failed).alias("s")
    )
    return counts.select("user_id", "period_start", P.guarded_ratio(F.col("f"), F.col("s"), 4).alias("ratio"))


@query(
    "b19_branch_by_service",
    "SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'warehouse/' || user_id"
    " ELSE 'lake/' || event_type END AS catalog_id FROM events",
)
def branch_by_service(spark, sf):
    warehouse = F.concat(F.lit("warehouse/"), F.col("user_id").cast("string"))
    catalog = F.when(F.col("event_type").isin("purchase", "signup"), warehouse).otherwise(
        F.concat(F.lit("lake/"), F.col("event_type"))
    )
    return table(spark, sf, "events").select("event_id", catalog.alias("catalog_id"))


@query(
    "b20_severity_band",
    "SELECT event_id, CASE WHEN value >= 95 THEN 'critical' WHEN value >= 85 THEN 'warning' ELSE 'ok' END AS severity FROM events",
)
def severity_band(spark, sf):
    return table(spark, sf, "events").select("event_id", P.severity(F.col("value")).alias("severity"))


@query(
    "b21_tagged_resources",
    """
    SELECT lower(p_type) AS environment, split_part(p_name, ' ', 2) AS resource, count(*) AS n
    FROM part WHERE p_brand = 'Brand#7' GROUP BY ALL
    """,
)
def tagged_resources(spark, sf):
    tags = F.create_map(F.lit("Project"), F.col("p_brand"), F.lit("Environment"), F.col("p_type"))
    arn = F.concat(F.lit("arn:aws:service:::"), F.replace("p_name", F.lit(" "), F.lit("/")))
    tagged = table(spark, sf, "part").select(tags.alias("tags"), arn.alias("arn"))
    chosen = tagged.where(F.element_at("tags", F.lit("Project")) == "Brand#7")
    return chosen.groupBy(
        F.lower(F.element_at("tags", F.lit("Environment"))).alias("environment"),
        F.split_part("arn", F.lit("/"), F.lit(2)).alias("resource"),
    ).agg(F.count(F.lit(1)).alias("n"))
