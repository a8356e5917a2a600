"""Streaming jobs, run to the end of what is available and compared as tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import alarms, metrics
from tidewatch.operators.percentile import exact_percentiles
from tidewatch.queries.registry import query, table
from tidewatch.queries.sources import _database, event_records
from tidewatch.queries.windows import lags
from tidewatch.session import scratch
from tidewatch.sources.topics import decode
from tidewatch.streaming import alarms as live
from tidewatch.streaming import late, routing, runs, topics
from tidewatch.streaming.metrics import round_trips, unique_within, windowed

DAY = 86400
# More than the time that all events span: any order of arrival is in time.
WHOLE = 400 * DAY
PARTS = 4
POINT_FILES = 12
DAY_SQL = "CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400"
QUARTER_SQL = "CAST(floor(epoch(ts) / 900) AS BIGINT) * 900"


def event_stream(spark, sf):
    return runs.file_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


def record_stream(spark, sf):
    return event_records(event_stream(spark, sf))


def stream_in_order(spark, sf):
    """Events as a stream of micro-batches, each of which holds the events after those of the one before."""
    events = table(spark, sf, "events")
    path = scratch(spark, "landed")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.struct(F.min(at).alias("lo"), (F.max(at) + 1).alias("hi"))).scalar()
    part = F.floor((at - span["lo"]) * PARTS / (span["hi"] - span["lo"]))
    for i in range(PARTS):
        events.where(part == i).repartition(2).write.mode("append").parquet(path)
    return runs.file_stream(spark, path, events.schema, files_per_trigger=2)


def closed_points(spark, sf, period, series, aggregates, label, files=8):
    """A windowed stream job's finished periods as the stream of a second job: some files after the other, then a closing point."""
    final = windowed(stream_in_order(spark, sf), "ts", period, series, aggregates)
    points = runs.update_available(final, scratch(spark, label), mode="append").drop("batch")
    path = scratch(spark, f"{label}-landed")
    land_points(points, series[0], path)
    return runs.file_stream(spark, f"{path}/*", points.schema, files_per_trigger=files)


def land_points(points, series, path):
    """Points in ``POINT_FILES`` files and their closing point in one that comes after them.

    A job leaves a file per batch and shuffle partition, and a stream that takes
    some files a batch would have as many batches as there are partitions.
    """
    points.repartition(POINT_FILES, series).write.parquet(f"{path}/part=0")
    live.closing_point(points, series, WHOLE).write.parquet(f"{path}/part=1")


@query(
    "i01_topic_ingest",
    "SELECT 'dev' AS environment, 'retail' AS business, 'web' AS app, event_type AS event, event_id AS \"offset\","
    " CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
)
def topic_ingest(spark, sf):
    parsed = topics.parsed(record_stream(spark, sf), "props string")
    rows = parsed.select(
        "environment", "business", "app", "event", "offset", F.from_json("body.props", "k int")["k"].alias("k")
    )
    return runs.append_available(rows, scratch(spark, "ingest"))


def _windows(spark, sf, period, series, aggregates, label):
    stream = windowed(event_stream(spark, sf), "ts", period, series, aggregates)
    path = scratch(spark, label)
    return runs.latest_update(runs.update_available(stream, path), [*series, "period_start"])


@query(
    "i01_routed_ingest",
    """
    SELECT CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type ELSE 'unrouted ' || event_type END AS event,
           event_id AS "offset", user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k
    FROM events
    """,
)
def routed_ingest(spark, sf):
    # One stream, one table per declared event; the others are kept apart under their names.
    body = topics.parsed(event_records(stream_in_order(spark, sf)), "user_id bigint, props string")
    rows = body.select("event", "offset", "body.user_id", F.from_json("body.props", "k int")["k"].alias("k"))
    columns = [{"name": "offset", "type": "bigint"}, {"name": "user_id", "type": "bigint"}, {"name": "k", "type": "int"}]
    declared = ["view", "click", "purchase"]
    router = routing.Router(spark, _database(spark, "routed"), scratch(spark, "routed"), columns, declared)
    router.run_available(rows, F.col("event"), scratch(spark, "routed-checkpoint"))
    names = ["event", "offset", "user_id", "k"]
    out = router.rows(routing.UNROUTED).withColumn("event", F.concat(F.lit("unrouted "), "event")).select(names)
    for event in declared:
        out = out.unionByName(router.rows(event).withColumn("event", F.lit(event)).select(names))
    return out


@query(
    "i02_late_rows",
    """
    WITH w AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS mark FROM events WHERE event_id % 5 <> 0)
    SELECT 'first and late' AS query, 'dedupeWithinWatermark' AS kind, CAST(count(*) AS BIGINT) AS dropped
    FROM events, w WHERE event_id % 5 = 0 AND epoch_us(ts) <= mark
    """,
)
def late_rows(spark, sf):
    # The second file comes when the first one has moved the watermark past nearly all of it.
    events, folder, out, metrics_path = table(spark, sf, "events"), scratch(spark, "two-files"), scratch(spark, "in-time"), scratch(spark, "late")
    is_late = F.col("event_id") % 5 == 0
    for rows in (events.where(~is_late), events.where(is_late)):
        rows.write.mode("append").parquet(folder)
        once = unique_within(runs.file_stream(spark, folder, events.schema), "ts", ["event_id"], 3600)
        with late.late_rows(spark, metrics_path):
            runs.append_available(once, out, name="first and late")
    dropped = late.dropped_rows(spark, metrics_path)
    return dropped.groupBy("query", "kind").agg(F.sum("dropped").alias("dropped"))


@query(
    "i02_tumbling_windows",
    f"SELECT event_type, {DAY_SQL} AS period_start, count(*) AS n, max(value) AS largest FROM events GROUP BY ALL",
)
def tumbling_windows(spark, sf):
    aggregates = [F.count(F.lit(1)).alias("n"), F.max("value").alias("largest")]
    return _windows(spark, sf, DAY, ["event_type"], aggregates, "windows")


SPINE_SQL = f"""
  WITH c AS (SELECT event_type, {QUARTER_SQL} AS period_start, count(*) AS n FROM events GROUP BY ALL),
  spine AS (SELECT event_type, unnest(range((SELECT min(period_start) FROM c), (SELECT max(period_start) + 1 FROM c), 900)) AS period_start
            FROM (SELECT DISTINCT event_type FROM c)),
  filled AS (SELECT event_type, period_start, n FROM spine LEFT JOIN c USING (event_type, period_start))
"""


@query(
    "i03_fill_periods",
    SPINE_SQL + "SELECT event_type, period_start, coalesce(n, 0) AS n, n IS NULL AS filled FROM filled",
)
def fill_periods(spark, sf):
    counted = _windows(spark, sf, 900, ["event_type"], [F.count(F.lit(1)).alias("n")], "fill")
    return metrics.fill_periods(counted, ["event_type"], 900, {"n": 0})


# Windows that the watermark, one period behind the newest event, has closed.
CLOSED_SQL = f"""
  WITH m AS (SELECT epoch_ms(max(ts)) - 900000 AS mark FROM events),
  c AS (SELECT event_type, {QUARTER_SQL} AS period_start, count(*) AS n FROM events GROUP BY ALL),
  k AS (SELECT c.* FROM c, m WHERE (period_start + 900) * 1000 <= mark),
  e AS (SELECT event_type, min(period_start) AS lo FROM k GROUP BY event_type),
  spine AS (SELECT event_type, unnest(range(lo, (SELECT max(period_start) + 1 FROM k), 900)) AS period_start FROM e),
  filled AS (SELECT event_type, period_start, n FROM spine LEFT JOIN k USING (event_type, period_start))
"""


@query(
    "i03_fill_on_stream",
    CLOSED_SQL + "SELECT event_type AS series, period_start, CAST(coalesce(n, 0) AS DOUBLE) AS value, n IS NULL AS filled FROM filled",
)
def fill_on_stream(spark, sf):
    points = closed_points(spark, sf, 900, ["event_type"], [F.count(F.lit(1)).alias("n")], "counts")
    filled = live.filled_stream(points, "event_type", "n", 900, 0.0, late=WHOLE)
    return runs.append_available(filled, scratch(spark, "filled"))


@query(
    "i04_policies_on_stream",
    CLOSED_SQL + "SELECT event_type AS series, period_start, n IS NULL OR n < 1 AS breaching, coalesce(n >= 3, false) AS not_breaching FROM filled",
)
def policies_on_stream(spark, sf):
    points = closed_points(spark, sf, 900, ["event_type"], [F.count(F.lit(1)).alias("n")], "beats")
    filled = live.filled_stream(points, "event_type", "n", 900, None, late=WHOLE)
    heartbeat = alarms.Alarm("<", 1, missing="breaching")
    busy = alarms.Alarm(">=", 3, missing="notBreaching")
    judged = filled.select(
        "series", "period_start", heartbeat.breached(F.col("value")).alias("breaching"), busy.breached(F.col("value")).alias("not_breaching")
    )
    return runs.append_available(judged, scratch(spark, "judged"))


@query(
    "i04_missing_data_policy",
    SPINE_SQL
    + """
    SELECT event_type, period_start, n IS NULL OR n < 1 AS breaching, coalesce(n >= 3, false) AS not_breaching FROM filled
    """,
)
def missing_data_policy(spark, sf):
    counted = metrics.metric(table(spark, sf, "events"), 900, ["event_type"], {"n": "sample_count"})
    spine = metrics.fill_periods(counted, ["event_type"], 900, {})
    heartbeat = alarms.Alarm("<", 1, missing="breaching")
    busy = alarms.Alarm(">=", 3, missing="notBreaching")
    return spine.select(
        "event_type",
        "period_start",
        heartbeat.breached(F.col("n")).alias("breaching"),
        busy.breached(F.col("n")).alias("not_breaching"),
    )


QUIET = alarms.Alarm("<", 2, n=3, m=2, missing="breaching")


@query(
    "i05_streaming_alarm",
    f"""
    WITH c AS (SELECT user_id, {DAY_SQL} AS period_start, count(*) AS n FROM events GROUP BY ALL),
    edges AS (SELECT user_id, min(period_start) AS lo, max(period_start) AS hi FROM c GROUP BY user_id),
    spine AS (SELECT user_id, unnest(range(lo, hi + 1, {DAY})) AS period_start FROM edges),
    b AS (SELECT user_id, period_start, CASE WHEN n IS NULL OR n < 2 THEN 1 ELSE 0 END AS breach
          FROM spine LEFT JOIN c USING (user_id, period_start)),
    s AS (SELECT user_id, period_start, CASE WHEN sum(breach) OVER (PARTITION BY user_id ORDER BY period_start
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 THEN 'ALARM' ELSE 'OK' END AS state FROM b),
    t AS (SELECT CAST(user_id AS VARCHAR) AS series, period_start,
            lag(state, 1, 'OK') OVER (PARTITION BY user_id ORDER BY period_start) AS previous_state, state FROM s)
    SELECT * FROM t WHERE state <> previous_state
    """,
)
def streaming_alarm(spark, sf):
    # The metric job writes one row per user and day; the alarm job reads them as its stream.
    points = metrics.metric(table(spark, sf, "events"), DAY, ["user_id"], {"n": "sample_count"})
    path = scratch(spark, "points")
    points.unionByName(live.closing_point(points, "user_id", WHOLE)).write.parquet(path)
    stream = runs.file_stream(spark, path, points.schema)
    changes = live.alarm_transitions(stream, "user_id", "n", DAY, QUIET, late=WHOLE)
    return runs.append_available(changes, scratch(spark, "alarm"))


# Days that the windowed job has closed, then the state per user up to ``__END__``.
CLOSED_DAYS_SQL = f"""
    WITH m AS (SELECT epoch_ms(max(ts)) - {DAY}000 AS mark FROM events),
    c AS (SELECT user_id, {DAY_SQL} AS period_start, count(*) AS n FROM events GROUP BY ALL),
    k AS (SELECT c.* FROM c, m WHERE (period_start + {DAY}) * 1000 <= mark),
    edges AS (SELECT user_id, min(period_start) AS lo, max(period_start) AS hi FROM k GROUP BY user_id),
    spine AS (SELECT user_id, unnest(range(lo, __END__ + 1, {DAY})) AS period_start FROM edges, (SELECT max(period_start) AS newest FROM k)),
    b AS (SELECT user_id, period_start, CASE WHEN n IS NULL OR n < 2 THEN 1 ELSE 0 END AS breach
          FROM spine LEFT JOIN k USING (user_id, period_start)),
    s AS (SELECT user_id, period_start, CASE WHEN sum(breach) OVER (PARTITION BY user_id ORDER BY period_start
            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 THEN 'ALARM' ELSE 'OK' END AS state FROM b),
    t AS (SELECT CAST(user_id AS VARCHAR) AS series, period_start,
            lag(state, 1, 'OK') OVER (PARTITION BY user_id ORDER BY period_start) AS previous_state, state FROM s)
    SELECT * FROM t WHERE state <> previous_state
"""


@query("i05_out_of_order", CLOSED_DAYS_SQL.replace("__END__", "hi"))
def out_of_order(spark, sf):
    # The windowed job's files come a few at a time, each with the days of some users.
    points = closed_points(spark, sf, DAY, ["user_id"], [F.count(F.lit(1)).alias("n")], "days", files=3)
    changes = live.alarm_transitions(points, "user_id", "n", DAY, QUIET, late=WHOLE)
    return runs.append_available(changes, scratch(spark, "ordered-alarm"))


@query("i05_silent_series", CLOSED_DAYS_SQL.replace("__END__", f"least(hi + 3 * {DAY}, newest)"))
def silent_series(spark, sf):
    # A user who is silent after the last event breaches, too, as the days pass.
    points = closed_points(spark, sf, DAY, ["user_id"], [F.count(F.lit(1)).alias("n")], "silence")
    changes = live.alarm_transitions(points, "user_id", "n", DAY, QUIET, late=WHOLE, silence=True)
    return runs.append_available(changes, scratch(spark, "silent-alarm"))


@query(
    "i06_absence",
    f"""
    WITH s AS (SELECT DISTINCT user_id, {QUARTER_SQL} AS last_seen FROM events),
    g AS (SELECT *, lead(last_seen) OVER (PARTITION BY user_id ORDER BY last_seen) AS next_seen FROM s),
    w AS (SELECT epoch_ms(max(ts)) - 900000 AS watermark FROM events)
    SELECT CAST(user_id AS VARCHAR) AS series, last_seen, last_seen + 96 * 900 + 900 AS deadline FROM g, w
    WHERE next_seen - last_seen >= 97 * 900 OR (next_seen IS NULL AND (last_seen + 97 * 900) * 1000 <= watermark)
    """,
)
def absence(spark, sf):
    silent = live.absences(event_stream(spark, sf), "user_id", "ts", 900, n=96)
    return runs.append_available(silent, scratch(spark, "absence"), large_state=True)


@query(
    "i07_compaction",
    """
    SELECT 'platform-dev.retail.web.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, max(event_id) AS "offset",
           arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id HAVING max(event_id) % 7 <> 0
    """,
)
def compaction(spark, sf):
    # Every seventh record deletes its key.
    deleting = F.when(F.col("offset") % 7 != 0, F.col("value"))
    newest = topics.newest_per_key(record_stream(spark, sf).withColumn("value", deleting), ["topic", "key"])
    changed = runs.update_available(newest, scratch(spark, "compact"))
    kept = topics.without_deleted(runs.latest_update(changed, ["topic", "key"]))
    return kept.select("topic", "key", "offset", F.from_json("value", "value double")["value"].alias("value"))


@query(
    "i07_expiring_deletes",
    """
    SELECT 'platform-dev.retail.web.' || event_type AS topic, CAST(user_id AS VARCHAR) AS key, max(event_id) AS "offset",
           arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id HAVING max(event_id) % 7 <> 0
    """,
)
def expiring_deletes(spark, sf):
    # Deleted keys leave the state ten days after; nothing older comes later than that.
    deleting = F.when(F.col("offset") % 7 != 0, F.col("value"))
    records = event_records(stream_in_order(spark, sf)).withColumn("value", deleting)
    newest = topics.compacted_stream(records, delete_retention=10 * DAY, late=DAY)
    changed = runs.update_available(newest, scratch(spark, "expiring"))
    kept = topics.without_deleted(runs.latest_update(changed, ["topic", "key"]))
    return kept.select("topic", "key", "offset", F.from_json("value", "value double")["value"].alias("value"))


@query(
    "i08_retention_by_age",
    "SELECT event_id AS \"offset\" FROM events WHERE epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 604800000",
)
def retention_by_age(spark, sf):
    return topics.retained_by_age(event_records(table(spark, sf, "events")), 604_800_000).select("offset")


@query(
    "i10_canary",
    """
    WITH r AS (SELECT event_id, ts + INTERVAL 1 SECOND * CASE event_type WHEN 'view' THEN 36 WHEN 'click' THEN 35 ELSE 5 END AS received
               FROM events WHERE event_type <> 'error'),
    w AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(received) FROM r)) - INTERVAL 60 SECOND AS mark)
    SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN 'pass'
                          WHEN ts + INTERVAL 35 SECOND < mark THEN 'fail' ELSE 'open' END AS status
    FROM events, w
    """,
)
def canary(spark, sf):
    # Errors never arrive and views arrive too late. Both streams wait a minute for late rows. What may still arrive when the input ends is open.
    sent = event_stream(spark, sf)
    delay = F.when(F.col("event_type") == "view", 36).when(F.col("event_type") == "click", 35).otherwise(5)
    received = (
        event_stream(spark, sf)
        .where("event_type <> 'error'")
        .withColumn("ts", F.col("ts").cast("timestamp") + F.make_interval(secs=delay))
    )
    decided = runs.append_available(round_trips(sent, received, "event_id"), scratch(spark, "canary"), join=True)
    messages = table(spark, sf, "events").select("event_id")
    return messages.join(decided.select("event_id", "status"), "event_id", "left").select(
        "event_id", F.coalesce("status", F.lit("open")).alias("status")
    )


@query(
    "i11_malformed_records",
    """
    SELECT event_type, count(*) FILTER (WHERE event_type <> 'view') AS decoded, count(*) FILTER (WHERE event_type = 'view') AS dropped
    FROM events GROUP BY event_type
    """,
)
def malformed_records(spark, sf):
    cut = F.when(F.col("event_type") == "view", F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    records = event_stream(spark, sf).select("event_type", cut.alias("value"))
    counted = decode(records, "k int").groupBy("event_type").agg(
        F.count("body").alias("decoded"), F.count_if(F.col("body").isNull()).alias("dropped")
    )
    return runs.latest_update(runs.update_available(counted, scratch(spark, "malformed")), ["event_type"])


@query("i12_redelivery", "SELECT event_id, user_id, value FROM events")
def redelivery(spark, sf):
    # Every record is delivered twice, which at-least-once production may do.
    events = event_stream(spark, sf)
    copies = events.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    once = unique_within(copies, "ts", ["event_id"], 3600).select("event_id", "user_id", "value")
    return runs.append_available(once, scratch(spark, "redelivery"))


@query(
    "i13_lag_percentile",
    """
    WITH heads AS (SELECT event_type, max(event_id) AS head, max(ts) AS head_ts FROM events GROUP BY event_type),
    committed AS (SELECT user_id, event_type, max(event_id) AS done, max(ts) AS done_ts FROM events GROUP BY ALL),
    l AS (SELECT event_type AS topic, head - done AS m, CAST(floor(epoch(head_ts)) AS BIGINT) - CAST(floor(epoch(done_ts)) AS BIGINT) AS s
          FROM committed JOIN heads USING (event_type))
    SELECT topic, max(m) AS most_messages, round(quantile_cont(s, 0.99), 6) AS p99_seconds, quantile_cont(s, 0.99) > 300 AS warning
    FROM l GROUP BY topic
    """,
)
def lag_percentile(spark, sf):
    lag = lags(spark, sf)
    most = lag.groupBy("topic").agg(F.max("offset_lag").alias("most_messages"))
    p99 = exact_percentiles(lag, ["topic"], "seconds_lag", {"p99": 0.99})
    return most.join(p99, "topic").select(
        "topic", "most_messages", F.round("p99", 6).alias("p99_seconds"), (F.col("p99") > 300).alias("warning")
    )


@query(
    "i13_lag_per_period",
    """
    WITH s AS (SELECT 'reader-' || user_id AS consumer_group, event_type AS topic, ts,
                      (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS seconds, event_id - lag(event_id) OVER w AS messages
               FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT consumer_group, topic, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS period_start, max(messages) AS most_messages,
           round(quantile_cont(seconds, 0.99), 6) AS p99_seconds
    FROM s WHERE seconds IS NOT NULL GROUP BY ALL
    """,
)
def lag_per_period(spark, sf):
    # A group that reads a topic is behind by what came since its read before.
    order = Window.partitionBy("consumer_group", "topic").orderBy("ts", "event_id")
    reads = table(spark, sf, "events").select(
        F.concat(F.lit("reader-"), F.col("user_id").cast("string")).alias("consumer_group"),
        F.col("event_type").alias("topic"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
    )
    behind = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6
    samples = reads.withColumn("seconds", behind).withColumn("messages", F.col("event_id") - F.lag("event_id").over(order))
    samples = samples.where("seconds IS NOT NULL")
    series = ["consumer_group", "topic"]
    p99 = metrics.metric(samples, 60, series, {"p99_seconds": "p99"}, value="seconds")
    most = metrics.metric(samples, 60, series, {"most_messages": "maximum"}, value="messages")
    return most.join(p99, [*series, "period_start"]).withColumn("p99_seconds", F.round("p99_seconds", 6))
