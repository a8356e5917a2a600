"""Counts, metric statistics, roll-ups and grouped lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import constraints, metrics, sketches
from tidewatch.operators.grouping import children_counts, children_per_parent
from tidewatch.operators.percentile import exact_percentiles
from tidewatch.plans import models, suites
from tidewatch.queries.registry import query, table
from tidewatch.session import scratch

DAY = 86400
DAY_SQL = "CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400"
HOUR_SQL = "CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600"
# Doubles are added in any order, so results are compared to six digits.
SUM_SQL = "round(sum(value), 6)"


@query(
    "d01_count_check",
    "SELECT count(*) AS n_expected, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_actual, false AS equal FROM orders",
)
def count_check(spark, sf):
    counts = table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count_if(F.col("o_orderstatus") != "P").alias("n_actual")
    )
    return counts.withColumn("equal", F.col("n_expected") == F.col("n_actual"))


@query("d02_grouped_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def grouped_count(spark, sf):
    return models.status_counts(table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("d03_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query(
    "d04_all_true",
    "SELECT 'all' AS scope, bool_and(quality >= 0) AS passed FROM labels UNION ALL"
    " SELECT 'toxic', bool_and(toxic = 0) FROM labels UNION ALL"
    " SELECT 'none', true FROM labels HAVING count(*) > 0",
)
def all_true(spark, sf):
    labels = table(spark, sf, "labels")
    tests = [
        ("all", labels, F.col("quality") >= 0),
        ("toxic", labels, F.col("toxic") == 0),
        ("none", labels.where("quality > 1"), F.col("toxic") == 0),
    ]
    rows = [suites.all_true(df, test, "passed").withColumn("scope", F.lit(scope)) for scope, df, test in tests]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "d05_success_metric",
    "SELECT d.source, CAST(min(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS INTEGER) AS success"
    " FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source",
)
def success_metric(spark, sf):
    checked = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return suites.success_metric(checked, F.col("quality") == 1, ["source"])


def _metric(name: str, kind: str, sql: str, period_sql: str = DAY_SQL, period: int = DAY):
    text = f"SELECT event_type, {period_sql} AS period_start, {sql} AS value FROM events GROUP BY ALL"

    @query(name, text)
    def run(spark, sf):
        found = metrics.metric(table(spark, sf, "events"), period, ["event_type"], {"value": kind})
        digits = {"sum": 6, "average": 9}.get(kind)
        return found.withColumn("value", F.round("value", digits)) if digits else found

    return run


_metric("d06_metric_sum", "sum", SUM_SQL, HOUR_SQL, 3600)
_metric("d07_metric_average", "average", "round(avg(value), 9)")
_metric("d08_metric_minimum", "minimum", "min(value)")
_metric("d09_metric_maximum", "maximum", "max(value)")
_metric("d10_metric_sample_count", "sample_count", "count(value)")


@query(
    "d06_revenue_sum",
    """
    SELECT l_returnflag, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) * 86400 AS period_start,
           round(sum(l_extendedprice * l_discount), 4) AS revenue, round(avg(l_extendedprice * l_discount), 9) AS mean
    FROM lineitem GROUP BY ALL
    """,
)
def revenue_sum(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("value", F.col("l_extendedprice") * F.col("l_discount"))
    stats = {"revenue": "sum", "mean": "average"}
    found = metrics.metric(lines, DAY, ["l_returnflag"], stats, ts="l_shipdate")
    return found.withColumns({"revenue": F.round("revenue", 4), "mean": F.round("mean", 9)})


@query(
    "d11_percentiles",
    "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"
    " FROM events GROUP BY event_type",
)
def percentiles(spark, sf):
    found = exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})
    return found.select("event_type", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query(
    "d11_percentiles_per_period",
    f"""
    SELECT event_type, {DAY_SQL} AS period_start, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95,
           round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY ALL
    """,
)
def percentiles_per_period(spark, sf):
    stats = {"n": "sample_count", "p95": "p95", "p99": "p99"}
    found = metrics.metric(table(spark, sf, "events"), DAY, ["event_type"], stats)
    return found.withColumns({name: F.round(name, 6) for name in ("p95", "p99")})


@query(
    "d12_sum_across_series",
    f"""
    WITH s AS (SELECT user_id, {DAY_SQL} AS period_start, max(value) AS v FROM events GROUP BY ALL)
    SELECT period_start, round(sum(v), 6) AS total FROM s GROUP BY period_start
    """,
)
def sum_across_series(spark, sf):
    per_user = metrics.metric(table(spark, sf, "events"), DAY, ["user_id"], {"v": "maximum"})
    return metrics.across_series(per_user, "v", "sum", "total").withColumn("total", F.round("total", 6))


@query(
    "d13_max_across_series",
    f"""
    WITH s AS (SELECT user_id, {DAY_SQL} AS period_start, {SUM_SQL} AS v FROM events GROUP BY ALL)
    SELECT period_start, max(v) AS largest FROM s GROUP BY period_start
    """,
)
def max_across_series(spark, sf):
    per_user = metrics.metric(table(spark, sf, "events"), DAY, ["user_id"], {"v": "sum"})
    return metrics.across_series(per_user, "v", "maximum", "largest").withColumn("largest", F.round("largest", 6))


@query(
    "d14_sum_of_components",
    f"SELECT {DAY_SQL} AS period_start, {SUM_SQL} AS total FROM events"
    " WHERE event_type IN ('error', 'signup', 'view') GROUP BY ALL",
)
def sum_of_components(spark, sf):
    found = metrics.sum_of_components(table(spark, sf, "events"), DAY, "event_type", ["error", "signup", "view"])
    return found.withColumn("total", F.round("total", 6))


@query(
    "d15_all_members",
    """
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'All' ELSE l_returnflag END AS l_returnflag,
           CASE WHEN grouping(l_linestatus) = 1 THEN 'All' ELSE l_linestatus END AS l_linestatus,
           count(*) AS n, round(sum(l_quantity), 6) AS quantity
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)
def all_members(spark, sf):
    sums = {"n": ("sample_count", F.lit(1)), "quantity": ("sum", F.col("l_quantity"))}
    found = metrics.with_all_members(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], sums, cube=True)
    return found.withColumn("quantity", F.round("quantity", 6))


@query(
    "d15_rollup_members",
    f"""
    SELECT CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS event_type,
           CASE WHEN grouping(user_id) = 1 THEN 'All' ELSE CAST(user_id AS VARCHAR) END AS user_id,
           {SUM_SQL} AS total
    FROM events GROUP BY ROLLUP (event_type, user_id)
    """,
)
def rollup_members(spark, sf):
    total = {"total": ("sum", F.col("value"))}
    found = metrics.with_all_members(table(spark, sf, "events"), ["event_type", "user_id"], total)
    return found.withColumn("total", F.round("total", 6))


@query(
    "d16_duplicate_groups",
    """
    WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
    SELECT DISTINCT l_orderkey || '/' || l_linenumber AS key,
           l_orderkey || '/' || l_linenumber || ' (in ' || l_suppkey || ')' AS detail
    FROM lineitem JOIN d USING (l_orderkey, l_linenumber)
    """,
)
def duplicate_groups(spark, sf):
    return constraints.unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_suppkey").select("key", "detail")


@query(
    "d17_uniqueness",
    """
    SELECT 'c_custkey' AS keys, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, true AS is_unique FROM customer
    UNION ALL
    SELECT 'l_orderkey,l_linenumber', count(*), count(DISTINCT (l_orderkey, l_linenumber)), false FROM lineitem
    """,
)
def uniqueness(spark, sf):
    one = constraints.is_unique(table(spark, sf, "customer"), ["c_custkey"])
    two = constraints.is_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return one.withColumn("keys", F.lit("c_custkey")).unionByName(two.withColumn("keys", F.lit("l_orderkey,l_linenumber")))


@query(
    "d18_children_per_parent",
    "SELECT o_custkey, o_orderkey, count(*) AS n_rows FROM orders GROUP BY ALL",
)
def children(spark, sf):
    return children_per_parent(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


@query(
    "d18_children_counts",
    "SELECT o_custkey, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_children FROM orders GROUP BY o_custkey",
)
def counts_of_children(spark, sf):
    return children_counts(children(spark, sf), ["o_custkey"])


@query(
    "d19_first_of_group",
    "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name",
)
def first_of_group(spark, sf):
    from tidewatch.operators.ordering import first_per_key

    parts = table(spark, sf, "part").select("p_name", "p_partkey", "p_brand")
    return first_per_key(parts, ["p_name"], ["p_partkey"])


@query(
    "d20_empty_check",
    "SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) = 0 AS is_empty FROM customer"
    " LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey",
)
def empty_check(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 300000")
    counts = large.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.select("c_custkey", n.alias("n"), (n == 0).alias("is_empty"))


SKETCH_FRACTIONS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "d11_merged_sketches",
    """
    WITH e AS (SELECT event_type, value FROM events WHERE value IS NOT NULL UNION ALL SELECT 'All', value FROM events WHERE value IS NOT NULL),
    q AS (SELECT event_type, count(*) AS n FROM e GROUP BY event_type)
    SELECT event_type, n, true AS p50_in_bound, true AS p95_in_bound, true AS p99_in_bound FROM q
    """,
)
def merged_sketches(spark, sf):
    # Stored sketches of days are merged to the whole time and to all types; their ranks are then held against all values.
    events = table(spark, sf, "events")
    path = scratch(spark, "sketches")
    sketches.sketched(events, 86400, ["event_type"]).write.parquet(path)
    stored = sketches.rolled_up(spark.read.parquet(path), ["event_type"], ["event_type"])
    found = sketches.percentiles(sketches.merged(stored, ["event_type"]), SKETCH_FRACTIONS)
    values = events.select("event_type", "value")
    every = values.unionByName(values.withColumn("event_type", F.lit("All")))
    off = sketches.rank_errors(found, every, ["event_type"], "value", SKETCH_FRACTIONS)
    held = [(F.col(f"off.{p}") <= sketches.RANK_ERROR).alias(f"{p}_in_bound") for p in SKETCH_FRACTIONS]
    return found.join(off.alias("off"), "event_type").select("event_type", "n", *held)
