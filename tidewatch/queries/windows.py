"""Alarm evaluation, bands, compaction, lag, gaps and positions; sorting and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import alarms, logs, metrics, seasonal
from tidewatch.operators.grouping import children_per_parent
from tidewatch.operators.ordering import first_per_key, smallest_per_group, with_position
from tidewatch.plans import alarm_flow
from tidewatch.queries.registry import query, table
from tidewatch.queries.sources import event_records
from tidewatch.session import literal_rows
from tidewatch.streaming.topics import compacted

DAY = 86400
DAY_SQL = "CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400"
QUARTER_SQL = "CAST(floor(epoch(ts) / 900) AS BIGINT) * 900"
SUM_SQL = "sum(value)"
DAILY_ERRORS = alarms.Alarm(">=", 0.20, n=2, m=2)

STATES_SQL = f"""
  WITH c AS (
    SELECT {DAY_SQL} AS period_start, count(*) FILTER (WHERE event_type = 'error') AS failures,
           count(*) FILTER (WHERE event_type <> 'error') AS successes
    FROM events GROUP BY ALL),
  spine AS (SELECT unnest(range(min(period_start), max(period_start) + 1, {DAY})) AS period_start FROM c),
  filled AS (SELECT period_start, coalesce(failures, 0) AS f, coalesce(successes, 0) AS s FROM spine LEFT JOIN c USING (period_start)),
  ratios AS (SELECT *, CASE WHEN f + s >= 10 THEN f / (f + s) ELSE 0.0 END AS ratio FROM filled),
  states AS (
    SELECT period_start, f, s, ratio, CASE WHEN sum(CASE WHEN ratio >= 0.20 THEN 1 ELSE 0 END)
             OVER (ORDER BY period_start ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 THEN 'ALARM' ELSE 'OK' END AS state
    FROM ratios)
"""


@query("e01_m_of_n_alarm", STATES_SQL + "SELECT period_start, f AS failures, s AS successes, ratio, state FROM states")
def m_of_n_alarm(spark, sf):
    failed = F.col("event_type") == "error"
    states = alarm_flow.failure_ratio_states(table(spark, sf, "events"), failed, DAY, 10, DAILY_ERRORS)
    return states.select("period_start", "failures", "successes", "ratio", "state")


@query(
    "e02_state_transitions",
    STATES_SQL
    + """
    , changes AS (SELECT period_start, lag(state, 1, 'OK') OVER (ORDER BY period_start) AS previous_state, state FROM states)
    SELECT * FROM changes WHERE state <> previous_state
    """,
)
def state_transitions(spark, sf):
    failed = F.col("event_type") == "error"
    changes = alarm_flow.failure_ratio_transitions(table(spark, sf, "events"), failed, DAY, 10, DAILY_ERRORS)
    return changes.select("period_start", "previous_state", "state")


@query(
    "e01_alarm_per_series",
    f"""
    WITH c AS (
      SELECT user_id, {DAY_SQL} AS period_start, count(*) FILTER (WHERE event_type = 'error') AS f,
             count(*) FILTER (WHERE event_type <> 'error') AS s
      FROM events GROUP BY ALL),
    spine AS (SELECT user_id, unnest(range((SELECT min(period_start) FROM c), (SELECT max(period_start) + 1 FROM c), {DAY})) AS period_start
              FROM (SELECT DISTINCT user_id FROM c)),
    ratios AS (
      SELECT user_id, period_start, CASE WHEN coalesce(f, 0) + coalesce(s, 0) >= 2 THEN f / (f + s) ELSE 0.0 END AS ratio
      FROM spine LEFT JOIN c USING (user_id, period_start))
    SELECT user_id, period_start, CASE WHEN sum(CASE WHEN ratio >= 0.5 THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY period_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2
           THEN 'ALARM' ELSE 'OK' END AS state
    FROM ratios
    """,
)
def alarm_per_series(spark, sf):
    failed = F.col("event_type") == "error"
    two_of_three = alarms.Alarm(">=", 0.5, n=3, m=2)
    states = alarm_flow.failure_ratio_states(table(spark, sf, "events"), failed, DAY, 2, two_of_three, ["user_id"])
    return states.select("user_id", "period_start", "state")


@query(
    "e01_alarm_definitions",
    f"""
    WITH d(alarm, metric, statistic, period, n, m, comparator, threshold, missing) AS (VALUES
      ('error-warning', 'error', 'sample_count', 86400, 3, 2, '>=', 65, false), ('error-critical', 'error', 'sample_count', 86400, 2, 2, '>=', 75, false),
      ('view-quiet', 'view', 'sample_count', 900, 96, 50, '<', 1, true), ('click-mean', 'click', 'average', 86400, 1, 1, '>', 50, false)),
    x AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events),
    c AS (SELECT alarm, t - t % period AS period_start, CASE statistic WHEN 'average' THEN avg(value) ELSE count(value) END AS v
          FROM x JOIN d ON event_type = metric GROUP BY alarm, period, statistic, t - t % period),
    r AS (SELECT min(t) AS lo, max(t) AS hi FROM x),
    spine AS (SELECT d.*, unnest(range(lo - lo % period, hi - hi % period + 1, period)) AS period_start FROM d, r),
    b AS (SELECT spine.*, v, coalesce(CASE comparator WHEN '>=' THEN v >= threshold WHEN '<' THEN v < threshold ELSE v > threshold END, missing) AS breach
          FROM spine LEFT JOIN c USING (alarm, period_start)),
    h AS (SELECT *, sum(breach::INT) OVER w - coalesce(sum(breach::INT) OVER (PARTITION BY alarm ORDER BY period_start RANGE BETWEEN UNBOUNDED PRECEDING AND n * period PRECEDING), 0) AS hits
          FROM b WINDOW w AS (PARTITION BY alarm ORDER BY period_start))
    SELECT alarm, period_start, round(v, 9) AS value, breach, CASE WHEN hits >= m THEN 'ALARM' ELSE 'OK' END AS state FROM h
    """,
)
def alarm_definitions(spark, sf):
    # A warning and a critical alarm on one metric, a day-long silence alarm on quarters of an hour, and a mean.
    definitions = literal_rows(
        spark,
        [
            ("error-warning", "error", "sample_count", 86400, 3, 2, ">=", 65.0, "notBreaching"),
            ("error-critical", "error", "sample_count", 86400, 2, None, ">=", 75.0, "notBreaching"),
            ("view-quiet", "view", "sample_count", 900, 96, 50, "<", 1.0, "breaching"),
            ("click-mean", "click", "average", 86400, 1, 1, ">", 50.0, "notBreaching"),
        ],
        "alarm string, metric string, statistic string, period int, n int, m int, comparator string, threshold double, missing string",
    )
    points = table(spark, sf, "events").withColumnRenamed("event_type", "metric")
    states = alarms.evaluate_definitions(points, definitions, [])
    return states.withColumn("value", F.round("value", 9))


@query(
    "e03_anomaly_band",
    f"""
    WITH p AS (SELECT event_type, {DAY_SQL} AS period_start, {SUM_SQL} AS total FROM events GROUP BY ALL),
    b AS (
      SELECT *, avg(total) OVER w AS mean, stddev_samp(total) OVER w AS spread FROM p
      WINDOW w AS (PARTITION BY event_type ORDER BY period_start ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, coalesce(total > mean + 1 * spread, false) AS breach FROM b)
    SELECT event_type, period_start, round(total, 6) AS total, round(mean + 1 * spread, 4) AS upper, round(mean - 1 * spread, 4) AS lower, breach,
           CASE WHEN sum(CASE WHEN breach THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY period_start
             ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 THEN 'ALARM' ELSE 'OK' END AS state
    FROM f
    """,
)
def anomaly_band(spark, sf):
    # A band of one deviation; two of the test data's deviations are never passed twice in a row.
    daily = metrics.metric(table(spark, sf, "events"), DAY, ["event_type"], {"total": "sum"})
    states = alarms.anomaly_states(daily, ["event_type"], "total", width=1)
    return states.withColumns({"total": F.round("total", 6), "upper": F.round("upper", 4), "lower": F.round("lower", 4)})


# Six-hour counts with a season of a day, the state of a series stepped through row by row.
SEASONAL_SQL = """
    WITH RECURSIVE c AS (SELECT event_type, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS period_start, count(*) AS n FROM events GROUP BY ALL),
    spine AS (SELECT event_type, unnest(range((SELECT min(period_start) FROM c), (SELECT max(period_start) + 1 FROM c), 21600)) AS period_start
              FROM (SELECT DISTINCT event_type FROM c)),
    o AS (SELECT event_type, period_start, coalesce(n, 0)::DOUBLE AS x, period_start // 21600 % 4 + 1 AS place,
                 row_number() OVER (PARTITION BY event_type ORDER BY period_start) AS k FROM spine LEFT JOIN c USING (event_type, period_start)),
    f AS (SELECT event_type, k, period_start, x, x AS level, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS seasons, 0.0::DOUBLE AS spread, NULL::DOUBLE AS upper, false AS breach
          FROM o WHERE k = 1
          UNION ALL
          SELECT event_type, k, period_start, x, CASE WHEN breach THEN level ELSE level + 0.2 * err END,
                 CASE WHEN breach THEN seasons ELSE list_transform(seasons, lambda v, i: CASE WHEN i = place THEN v + 0.3 * err ELSE v END) END,
                 CASE WHEN breach THEN spread ELSE (1.0 - 0.2) * spread + 0.2 * err * err END, upper, breach
          FROM (SELECT *, coalesce(x > upper, false) AS breach
                FROM (SELECT o.event_type, o.k, o.period_start, o.x, o.place, f.level, f.seasons, f.spread, o.x - (f.level + f.seasons[o.place]) AS err,
                             CASE WHEN o.k > 2 * 4 THEN f.level + f.seasons[o.place] + 2.0 * sqrt(f.spread) END AS upper
                      FROM f JOIN o ON o.event_type = f.event_type AND o.k = f.k + 1)))
    SELECT event_type, period_start, CAST(x AS BIGINT) AS n, round(upper, 6) AS upper, breach FROM f
"""


@query("e03_seasonal_band", SEASONAL_SQL)
def seasonal_counts(spark, sf):
    counted = metrics.metric(table(spark, sf, "events"), 21600, ["event_type"], {"n": "sample_count"})
    filled = metrics.fill_periods(counted, ["event_type"], 21600, {"n": 0})
    band = seasonal.seasonal_band(filled, ["event_type"], "n", 21600, seasonal.Season(4))
    return band.select("event_type", "period_start", F.col("n").cast("bigint").alias("n"), F.round("upper", 6).alias("upper"), "breach")


@query(
    "e04_first_per_key",
    "SELECT p_brand, p_partkey, p_name, p_retailprice FROM part"
    " QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1",
)
def keep_first(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    return first_per_key(parts, ["p_brand"], ["p_retailprice", "p_partkey"])


@query(
    "e05_latest_per_key",
    """
    WITH l AS (
      SELECT event_type, user_id, event_id, value FROM events
      QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1)
    SELECT 'platform-dev.retail.web.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, event_id AS "offset"
    FROM l WHERE value >= 5
    """,
)
def latest_per_key(spark, sf):
    # Values below 5 are sent as deletions of their key.
    events = table(spark, sf, "events")
    records = event_records(events)
    small = F.from_json("value", "value double")["value"] < 5
    sent = records.withColumn("value", F.when(~small, F.col("value")))
    return compacted(sent).select("topic", "key", "offset")


@query(
    "e06_consumer_lag",
    """
    WITH heads AS (SELECT event_type, max(event_id) AS head, max(ts) AS head_ts FROM events GROUP BY event_type),
    committed AS (SELECT user_id, event_type, max(event_id) AS done, max(ts) AS done_ts FROM events GROUP BY ALL)
    SELECT 'reader-' || user_id AS consumer_group, event_type AS topic, head - done AS offset_lag,
           CAST(floor(epoch(head_ts)) AS BIGINT) - CAST(floor(epoch(done_ts)) AS BIGINT) AS seconds_lag
    FROM committed JOIN heads USING (event_type)
    """,
)
def consumer_lag(spark, sf):
    return lags(spark, sf).select("consumer_group", "topic", "offset_lag", "seconds_lag")


def lags(spark, sf):
    """Every user reads each topic up to its own last event."""
    stamped = table(spark, sf, "events").select(
        F.col("event_type").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("reader-"), F.col("user_id").cast("string")).alias("consumer_group"),
    )
    committed = stamped.groupBy("consumer_group", "topic", "partition").agg(
        F.max("offset").alias("committed_offset"), F.max("timestamp").alias("committed_ts")
    )
    return metrics.lag_by_group(stamped, committed)


@query(
    "e07_heartbeat_gaps",
    f"""
    WITH s AS (SELECT DISTINCT event_type, {QUARTER_SQL} AS last_seen FROM events),
    g AS (SELECT *, lead(last_seen) OVER (PARTITION BY event_type ORDER BY last_seen) AS next_seen FROM s)
    SELECT event_type, last_seen, next_seen, (next_seen - last_seen) // 900 - 1 AS missed_periods FROM g
    WHERE (next_seen - last_seen) // 900 - 1 >= 8
    """,
)
def heartbeat_gaps(spark, sf):
    return alarms.heartbeat_gaps(table(spark, sf, "events"), ["event_type"], "ts", 900, 8)


@query(
    "e07_open_silences",
    f"""
    WITH s AS (SELECT DISTINCT user_id, {QUARTER_SQL} AS last_seen FROM events),
    g AS (SELECT *, lead(last_seen) OVER (PARTITION BY user_id ORDER BY last_seen) AS next_seen FROM s),
    e AS (SELECT max({QUARTER_SQL}) AS last FROM events)
    SELECT user_id, last_seen, next_seen, (coalesce(next_seen, last) - last_seen) // 900 - 1 AS missed_periods FROM g, e
    WHERE (coalesce(next_seen, last) - last_seen) // 900 - 1 >= 96
    """,
)
def open_silences(spark, sf):
    events = table(spark, sf, "events")
    end = events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return alarms.heartbeat_gaps(events, ["user_id"], "ts", 900, 96, until=end)


@query("e08_row_position", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def row_position(spark, sf):
    return with_position(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select(
        "o_orderkey", "position"
    )


@query("f01_order_by", "SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_custkey")
def order_by(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").orderBy("c_custkey")


@query(
    "f02_latest_documents",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS status, epoch_us(ts) AS ts_us FROM events"
    " WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
)
def latest_documents(spark, sf):
    errors = table(spark, sf, "events").where("event_type = 'error'").select("event_id", "props", "ts")
    body = logs.nested_fields(errors, "props", "k int", {"status": "k"}, "k")
    newest = logs.latest(body, [F.desc("ts"), F.desc("event_id")], 20)
    return newest.select("event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))


@query("f03_preview", "SELECT count(*) AS n, count(*) AS n_known FROM (SELECT * FROM orders LIMIT 10)")
def preview(spark, sf):
    # Which rows a preview shows is free; their number and origin are not.
    orders = table(spark, sf, "orders")
    shown = orders.limit(10).join(orders.select("o_orderkey", F.lit(1).alias("known")), "o_orderkey", "left")
    return shown.agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("n_known"))


@query(
    "f04_sorted_distinct_list",
    "SELECT p_brand, p_type, count(*) AS n_rows FROM part GROUP BY ALL",
)
def sorted_distinct_list(spark, sf):
    return children_per_parent(table(spark, sf, "part"), ["p_brand"], "p_type").orderBy("p_brand", "p_type")


@query(
    "f05_first_of_sorted_list",
    """
    SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM (
      SELECT s_nationkey, s_name FROM supplier
      QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) <= 2) GROUP BY s_nationkey
    """,
)
def first_of_sorted_list(spark, sf):
    suppliers = table(spark, sf, "supplier")
    firsts = smallest_per_group(suppliers, ["s_nationkey"], "s_name", 2)
    return firsts.select("s_nationkey", F.array_join("s_name", ",").alias("names"))
