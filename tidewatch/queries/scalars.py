"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import names as N
from tidewatch.functions.predicates import is_json
from tidewatch.functions.schema import apply_schema, schema_violations
from tidewatch.queries.registry import query, table
from tidewatch.session import scratch
from tidewatch.sources import files
from tidewatch.sources.topics import topic_name


@query(
    "h01_strings",
    """
    SELECT c_custkey, format('{:05d}/{}', c_custkey, c_mktsegment) AS formatted, replace(c_name, '#', '-') AS replaced,
           split_part(c_name, '#', 2) AS number, lower(c_mktsegment) AS lowered, length(c_name) AS width,
           regexp_replace(c_name, '^Customer', '') AS unprefixed, regexp_replace(c_name, '7$', '') AS unsuffixed,
           CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS captured, 'n=' || c_nationkey AS labelled,
           'Customer' || c_custkey AS common_name, 'seg-' || lower(c_mktsegment) AS segment
    FROM customer
    """,
)
def strings(spark, sf):
    name = F.col("c_name")
    subject = F.concat(F.lit("O=Shop,CN=Customer"), F.col("c_custkey").cast("string"), F.lit(",C=NN"))
    path = F.concat(F.lit("/opt/dags/seg-"), F.lower("c_mktsegment"), F.lit("/job.py"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.format_string("%05d/%s", "c_custkey", "c_mktsegment").alias("formatted"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"),
        F.element_at(F.split(name, "#"), 2).alias("number"),
        F.lower("c_mktsegment").alias("lowered"),
        F.length(name).cast("bigint").alias("width"),
        N.without_prefix(name, "Customer").alias("unprefixed"),
        N.without_suffix(name, "7").alias("unsuffixed"),
        F.regexp_extract(name, "#0*([0-9]+)$", 1).cast("bigint").alias("captured"),
        F.array_join(F.array(F.lit("n"), F.col("c_nationkey").cast("string")), "=").alias("labelled"),
        N.common_name(subject).alias("common_name"),
        N.first_segment_after(path, "/dags/").alias("segment"),
    )


@query(
    "h02_identifiers",
    """
    SELECT event_id, 'platform-dev.retail.web.' || event_type AS topic, 'platform_dev_shop_' || event_type AS database,
           'platform-dev-producer-' || event_type AS role, 'platform-dev-' || event_type || '-wg' AS workgroup,
           event_type || '/events/' || user_id || '/data.json' AS path, event_type || '-' || user_id AS slug
    FROM events
    """,
)
def identifiers(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        topic_name("dev", F.lit("retail"), F.lit("web"), kind).alias("topic"),
        N.database_of("dev", F.concat(F.lit("shop-"), kind)).alias("database"),
        N.role_of("dev", "producer", kind).alias("role"),
        N.workgroup_of("dev", kind).alias("workgroup"),
        N.object_path(kind, F.lit("events"), user, F.lit("json")).alias("path"),
        N.slug(kind, user).alias("slug"),
    )


@query(
    "h03_regex_predicates",
    """
    SELECT page_id, regexp_matches(split_part(split_part(url, '//', 2), '.', 1), '^[a-z][a-z0-9-]*$') AS host_is_slug,
           page_id % 300 <= 255 AND page_id % 40 <= 32 AS is_cidr, regexp_matches(url, '^https://') AS is_secure,
           length(CAST(page_id % 7 + 100000000000 AS VARCHAR)) = 12 AND url LIKE 'https%' AS is_role
    FROM pages
    """,
)
def regex_predicates(spark, sf):
    octet, width = (F.col("page_id") % 300).cast("string"), (F.col("page_id") % 40).cast("string")
    block = F.concat(F.lit("10.0."), octet, F.lit(".0/"), width)
    prefix = F.when(F.startswith("url", F.lit("https")), "arn:aws:iam::").otherwise("arn:aws:s3::")
    role = F.concat(prefix, (F.col("page_id") % 7 + 100_000_000_000).cast("string"), F.lit(":role/reader"))
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("."), F.lit(1))
    return table(spark, sf, "pages").select(
        "page_id",
        N.is_slug(host).alias("host_is_slug"),
        N.is_cidr(block).alias("is_cidr"),
        F.col("url").rlike("^https://").alias("is_secure"),
        N.is_role_arn(role).alias("is_role"),
    )


@query(
    "h04_json",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS encoded,
           event_type <> 'view' AS is_valid FROM events
    """,
)
def json(spark, sf):
    damaged = F.when(F.col("event_type") == "view", F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "k int")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("encoded"),
        is_json(damaged).alias("is_valid"),
    )


@query(
    "h05_null_handling",
    """
    SELECT d.doc_id, coalesce(quality, -1) AS quality, l.doc_id IS NOT NULL AS has_label,
           CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN 'clean' ELSE 'unknown' END AS verdict
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """,
)
def null_handling(spark, sf):
    labels = table(spark, sf, "labels").withColumn("labelled", F.lit(True))
    joined = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).cast(labels.schema["quality"].dataType).alias("quality"),
        F.col("labelled").isNotNull().alias("has_label"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").otherwise("unknown").alias("verdict"),
    )


@query(
    "h06_arrays",
    """
    WITH a AS (SELECT p_partkey, [p_brand, p_type, p_brand] AS tags, p_size FROM part)
    SELECT p_partkey, list_contains(tags, 'PROMO') AS is_promo, len(list_distinct(tags)) AS n_distinct,
           array_to_string(list_sort(list_distinct(tags)), ',') AS sorted, list_position(tags, 'SMALL') AS small_at,
           p_size AS n_range, p_size < 40 AS all_below, tags[1] AS first FROM a
    """,
)
def arrays(spark, sf):
    tags = F.flatten(F.array(F.array("p_brand", "p_type"), F.array("p_brand")))
    counted = F.sequence(F.lit(1), "p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_contains(tags, "PROMO").alias("is_promo"),
        F.size(F.array_distinct(tags)).cast("bigint").alias("n_distinct"),
        F.array_join(F.sort_array(F.array_distinct(tags)), ",").alias("sorted"),
        F.nullif(F.array_position(tags, "SMALL").cast("int"), F.lit(0)).alias("small_at"),
        F.size(counted).alias("n_range"),
        F.forall(counted, lambda x: x < 40).alias("all_below"),
        F.element_at(tags, 1).alias("first"),
    )


@query(
    "h07_maps",
    """
    SELECT p_partkey, 'brand,size,type' AS keys, p_brand AS brand, CAST(NULL AS VARCHAR) AS absent,
           CASE WHEN p_size > 25 THEN 'brand,size,type' ELSE 'brand,type' END AS kept, upper(p_type) || '!' AS shouted FROM part
    """,
)
def maps(spark, sf):
    merged = F.map_concat(
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand")),
        F.create_map(F.lit("size"), F.col("p_size").cast("string")),
    )
    kept = F.map_filter(merged, lambda k, v: (k != "size") | (v.try_cast("int") > 25))
    entries = F.map_from_entries(F.map_entries(F.transform_values(merged, lambda k, v: F.concat(F.upper(v), F.lit("!")))))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(F.array_sort(F.map_keys(merged)), ",").alias("keys"),
        F.element_at(merged, F.lit("brand")).alias("brand"),
        F.try_element_at(merged, F.lit("owner")).alias("absent"),
        F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"),
        F.element_at(entries, F.lit("type")).alias("shouted"),
    )


@query(
    "h08_math",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS per_discount, l_discount * 100 AS percent,"
    " CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS guarded FROM lineitem",
)
def math(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.try_divide("l_extendedprice", "l_discount").alias("per_discount"),
        (F.col("l_discount") * 100).alias("percent"),
        F.when(F.col("l_tax") > 0, F.col("l_discount") / F.col("l_tax")).alias("guarded"),
    )


@query(
    "h09_dates",
    """
    SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS minute,
           CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS five_minutes, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour,
           epoch_us(ts) // 1000 + 604800000 AS expires_ms, ts >= TIMESTAMP '2024-01-30 23:57:12' - INTERVAL 7 DAY AS recent
    FROM events
    """,
)
def dates(spark, sf):
    from tidewatch.operators.metrics import period_start

    ts = F.col("ts").cast("timestamp")
    newest = F.timestamp_millis(F.lit(1706659032000))
    return table(spark, sf, "events").select(
        "event_id",
        F.unix_millis(ts).alias("ms"),
        period_start(ts, 60).alias("minute"),
        period_start(ts, 300).alias("five_minutes"),
        F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:mm").alias("hour"),
        F.unix_millis(ts + F.make_interval(days=F.lit(7))).alias("expires_ms"),
        (ts >= newest - F.make_interval(days=F.lit(7))).alias("recent"),
    )


@query(
    "h10_fingerprint",
    "SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS fingerprint FROM customer",
)
def fingerprint(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("fingerprint"))


DECLARED = [
    {"name": "o_orderkey", "type": "smallint", "required": True},
    {"name": "o_custkey", "type": "varchar(3)"},
    {"name": "o_totalprice", "type": "decimal(7,2)"},
    {"name": "o_orderstatus", "type": "int"},
    {"name": "o_orderpriority", "type": "char(5)"},
]


@query(
    "h11_apply_schema",
    "SELECT TRY_CAST(o_orderkey AS SMALLINT)::INTEGER AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,"
    " CASE WHEN o_totalprice < 99999.995 THEN o_totalprice END AS o_totalprice,"
    " TRY_CAST(o_orderstatus AS INTEGER) AS o_orderstatus, o_orderpriority FROM orders",
)
def declared_schema(spark, sf):
    typed = apply_schema(table(spark, sf, "orders"), DECLARED)
    return typed.withColumn("o_orderkey", F.col("o_orderkey").cast("int")).withColumn(
        "o_totalprice", F.col("o_totalprice").cast("double")
    )


@query(
    "h11_schema_violations",
    """
    SELECT * FROM (
    SELECT 'o_custkey' AS "column", 'size' AS rule, count(*) AS n FROM orders WHERE length(CAST(o_custkey AS VARCHAR)) > 3
    UNION ALL SELECT 'o_totalprice', 'type', count(*) FROM orders WHERE o_totalprice >= 99999.995
    UNION ALL SELECT 'o_orderstatus', 'type', count(*) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'size', count(*) FROM orders WHERE length(o_orderpriority) > 5
    ) WHERE n > 0
    """,
)
def violations(spark, sf):
    return schema_violations(table(spark, sf, "orders"), DECLARED)


NESTED = [
    {"name": "o_orderkey", "type": "bigint"},
    {"name": "tags", "type": "array<string>"},
    {"name": "amounts", "type": "map<string,double>"},
    {"name": "customer", "type": "struct<key:bigint,status:string>"},
]


@query(
    "h11_nested_types",
    """
    SELECT fmt, o_orderkey, o_orderstatus || ',' || o_orderpriority AS tags, o_totalprice AS price, o_custkey AS customer, o_orderstatus AS status
    FROM orders, (SELECT unnest(['json', 'parquet']) AS fmt)
    """,
)
def nested_types(spark, sf):
    """Arrays, maps and structs land in both nested formats and come back with their declared types."""
    orders = table(spark, sf, "orders")
    nested = orders.select(
        "o_orderkey",
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.create_map(F.lit("total"), "o_totalprice").alias("amounts"),
        F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("customer"),
    )
    found = None
    for fmt in ("json", "parquet"):
        path = scratch(spark, f"nested-{fmt}")
        files.write_files(nested, path, fmt)
        rows = files.read_files(spark, path, fmt, NESTED).select(
            F.lit(fmt).alias("fmt"),
            "o_orderkey",
            F.array_join("tags", ",").alias("tags"),
            F.col("amounts")["total"].alias("price"),
            F.col("customer.key").alias("customer"),
            F.col("customer.status").alias("status"),
        )
        found = rows if found is None else found.unionByName(rows)
    return found


@query(
    "h11_nested_violations",
    """
    SELECT 'codes' AS "column", 'inner type' AS rule, count(*) AS n FROM orders HAVING count(*) > 0
    UNION ALL SELECT 'limits', 'inner type', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders HAVING count(*) FILTER (WHERE o_orderstatus = 'P') > 0
    UNION ALL SELECT 'item', 'inner type', count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders HAVING count(*) FILTER (WHERE o_orderstatus <> 'F') > 0
    """,
)
def nested_violations(spark, sf):
    """Parts of arrays, maps and structs that don't fit their declared types are counted."""
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        F.array(key, status).alias("codes"),
        F.create_map(F.lit("low"), key, F.lit("high"), F.when(status == "P", "none").otherwise(key)).alias("limits"),
        F.struct(F.when(status == "F", key).otherwise("x").alias("id"), status.alias("status")).alias("item"),
        F.array(key).alias("good"),
    )
    declared = [
        {"name": "codes", "type": "array<bigint>"},
        {"name": "limits", "type": "map<string,bigint>"},
        {"name": "item", "type": "struct<id:bigint,status:string>"},
        {"name": "good", "type": "array<bigint>"},
    ]
    return schema_violations(rows, declared)
