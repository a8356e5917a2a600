import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alarms, metrics, sketches
from tidewatch.operators.alarms import Alarm

P = 60


def series(spark, values, name="a"):
    """One row per non-missing period; None is a period without data."""
    data = [(name, i * P, float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "s string, period_start bigint, v double")


def test_period_start_before_1970(spark):
    df = spark.sql("SELECT timestamp_seconds(-1) AS a, timestamp_seconds(59) AS b, timestamp_seconds(60) AS c")
    row = df.select(*[metrics.period_start(F.col(c), P) for c in "abc"]).first()
    assert tuple(row) == (-60, 0, 60)


def test_statistics(spark, rows):
    df = spark.sql("SELECT 'a' AS s, timestamp_seconds(i) AS ts, IF(i = 3, NULL, i * 0.1D) AS value FROM (SELECT explode(sequence(0, 70)) AS i)")
    stats = {"total": "sum", "mean": "average", "low": "minimum", "high": "maximum", "n": "sample_count"}
    got = metrics.metric(df, P, ["s"], stats).orderBy("period_start").collect()
    assert [r["n"] for r in got] == [59, 11]
    assert got[0]["total"] == pytest.approx(sum(range(60)) / 10 - 0.3) and got[1]["high"] == 7.0
    assert got[0]["mean"] == pytest.approx(got[0]["total"] / 59)


def test_small_and_large_values_are_not_rounded(spark):
    df = spark.sql("SELECT 'a' AS s, timestamp_seconds(0) AS ts, v AS value FROM VALUES (0.004D), (0.004D), (0.123456D) AS t(v)")
    got = metrics.metric(df, P, ["s"], {"total": "sum", "mean": "average"}).first()
    assert got["total"] == pytest.approx(0.131456, abs=1e-12) and got["mean"] == pytest.approx(0.131456 / 3, abs=1e-12)
    large = spark.sql("SELECT 'a' AS s, timestamp_seconds(0) AS ts, 2e16D AS value")
    assert metrics.metric(large, P, ["s"], {"total": "sum"}).first()["total"] == 2e16
    total = {"total": ("sum", F.col("value"))}
    assert metrics.with_all_members(df, ["s"], total).where("s = 'All'").first()["total"] == pytest.approx(0.131456, abs=1e-12)


def test_sum_does_not_depend_on_order(spark):
    df = spark.range(100000).selectExpr("id * 0.01D AS v")
    a = df.agg(metrics.exact_sum(F.col("v"), 2)).first()[0]
    b = df.orderBy(F.desc("v")).repartition(13).agg(metrics.exact_sum(F.col("v"), 2)).first()[0]
    assert a == b == 49999500.0


def test_fill_between_and_at_the_edges(spark, rows):
    df = series(spark, [1, None, None, 4]).unionByName(series(spark, [None, 2, None, None], "b"))
    filled = metrics.fill_periods(df, ["s"], P, {"v": 0})
    assert rows(filled) == [
        ("a", 0, 1.0, False),
        ("a", 120, 0.0, True),
        ("a", 180, 4.0, False),
        ("a", 60, 0.0, True),
        ("b", 0, 0.0, True),
        ("b", 120, 0.0, True),
        ("b", 180, 0.0, True),
        ("b", 60, 2.0, False),
    ]


def test_fill_to_given_bounds(spark):
    df = series(spark, [None, 2])
    assert metrics.fill_periods(df, ["s"], P, {}, first=-120, last=240).count() == 7
    # Bounds inside the data never remove a row.
    assert metrics.fill_periods(series(spark, [1, 2, 3]), ["s"], P, {}, first=60, last=60).count() == 3
    assert metrics.fill_periods(df.where("false"), ["s"], P, {}).count() == 0


def test_null_member_is_not_a_total(spark, rows):
    df = spark.createDataFrame([("x", 1), (None, 2), (None, 6)], "d string, v int")
    v = F.col("v")
    stats = {
        "total": ("sum", v),
        "mean": ("average", v),
        "n": ("sample_count", v),
        "low": ("minimum", v),
        "high": ("maximum", v),
    }
    for cube in (False, True):
        got = metrics.with_all_members(df, ["d"], stats, cube)
        assert rows(got) == [("All", 9.0, 3.0, 3, 1, 6), ("x", 1.0, 1.0, 1, 1, 1), (None, 8.0, 4.0, 2, 2, 6)]


def test_components_and_series(spark, rows):
    df = spark.sql("SELECT c, timestamp_seconds(t) AS ts, v AS value FROM VALUES ('x', 0, 1D), ('x', 5, 2D), ('y', 9, 4D), ('z', 9, 100D) AS t(c, t, v)")
    assert rows(metrics.sum_of_components(df, P, "c", ["x", "y"])) == [(0, 7.0)]
    per_series = metrics.metric(df, P, ["c"], {"v": "maximum"})
    assert rows(metrics.across_series(per_series, "v", "maximum", "m")) == [(0, 100.0)]
    with pytest.raises(ValueError):
        metrics.across_series(per_series, "v", "average", "m")


def states(spark, values, alarm):
    filled = metrics.fill_periods(series(spark, values), ["s"], P, {}, first=0, last=(len(values) - 1) * P)
    out = alarms.alarm_states(filled, ["s"], "v", alarm)
    return "".join(r["state"][0] for r in out.orderBy("period_start").collect())


@pytest.mark.parametrize(
    ("values", "alarm", "expected"),
    [
        ([9, 9, 1, 9, 9], Alarm(">=", 5, n=2), "OAOOA"),
        ([9, 1, 9, 1, 1], Alarm(">=", 5, n=3, m=2), "OOAOO"),
        ([9, 1], Alarm(">=", 5, n=1), "AO"),
        ([5, 5], Alarm(">", 5, n=1), "OO"),
        ([0, None, None, 3], Alarm("<", 1, n=2, missing="breaching"), "OAAO"),
        ([0, None, 0, 3], Alarm("<", 1, n=2, missing="notBreaching"), "OOOO"),
    ],
)
def test_alarm_states(spark, values, alarm, expected):
    assert states(spark, values, alarm) == expected
    # Several definitions evaluated together agree with one on its own.
    points = [("a", i * P, float(v)) for i, v in enumerate(values) if v is not None]
    points += [("edge", 0, 0.0), ("edge", (len(values) - 1) * P, 0.0)]
    own = ("one", "a", "sum", P, alarm.n, alarm.m, alarm.comparator, float(alarm.threshold), alarm.missing)
    assert evaluated(spark, points, [own, ("other", "a", "sum", P, 7, 7, ">", 0.0, "breaching")])["one"] == expected


DEFINITION = "alarm string, metric string, statistic string, period int, n int, m int, comparator string, threshold double, missing string"


def evaluated(spark, points, definitions):
    df = spark.createDataFrame(points, "metric string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    rows = alarms.evaluate_definitions(df, spark.createDataFrame(definitions, DEFINITION), []).orderBy("alarm", "period_start").collect()
    return {d[0]: "".join(r["state"][0] for r in rows if r["alarm"] == d[0]) for d in definitions}


def test_two_alarms_on_one_metric(spark):
    points = [("m", i * P, float(v)) for i, v in enumerate([90, 90, 99, 99, 10, 99])]
    limits = [("warning", "m", "average", P, 2, 2, ">=", 85.0, "notBreaching"), ("critical", "m", "average", P, 2, 2, ">=", 95.0, "notBreaching")]
    assert evaluated(spark, points, limits) == {"warning": "OAAAOO", "critical": "OOOAOO"}


def test_a_stray_time_is_an_error(spark):
    df = series(spark, [1, 2]).unionByName(series(spark, [3]).withColumn("period_start", F.lit(10**9 // P * P).cast("long")))
    with pytest.raises(Exception, match="more than 100 periods"):
        metrics.fill_periods(df, ["s"], P, {}, most=100).collect()
    with pytest.raises(Exception, match="no period_start"):
        metrics.fill_periods(df.withColumn("period_start", F.lit(None).cast("long")), ["s"], P, {}).collect()


def test_transitions(spark):
    filled = series(spark, [9, 9, 1, 9, 9]).unionByName(series(spark, [1, 1], "b"))
    changed = alarms.transitions(alarms.alarm_states(filled, ["s"], "v", Alarm(">=", 5)), ["s"])
    got = [(r["s"], r["period_start"], r["previous_state"], r["state"]) for r in changed.orderBy("period_start").collect()]
    assert got == [("a", 60, "OK", "ALARM"), ("a", 120, "ALARM", "OK"), ("a", 240, "OK", "ALARM")]


@pytest.mark.parametrize("wrong", [{"comparator": "="}, {"missing": "ignore"}, {"m": 3}, {"m": 0, "n": 0}])
def test_wrong_alarms(wrong):
    with pytest.raises(ValueError):
        Alarm(**{"comparator": ">", "threshold": 1, "n": 2, **wrong})


def test_band_leaves_out_the_current_row(spark):
    df = series(spark, [10, 12, 11, 100, 100, 11])
    got = alarms.anomaly_states(df, ["s"], "v", width=2, history=3).orderBy("period_start").collect()
    assert [r["upper"] is None for r in got] == [True, True, False, False, False, False]
    assert [r["breach"] for r in got] == [False, False, False, True, False, False]
    assert got[3]["upper"] == pytest.approx(11 + 2 * 1.0)


def test_heartbeat_gaps(spark):
    df = spark.sql("SELECT 'a' AS s, timestamp_seconds(t) AS ts FROM VALUES (0), (1), (59), (60), (200), (420) AS v(t)")
    got = alarms.heartbeat_gaps(df, ["s"], "ts", P, n=2).collect()
    assert [(r["last_seen"], r["next_seen"], r["missed_periods"]) for r in got] == [(180, 420, 3)]
    assert alarms.heartbeat_gaps(df, ["s"], "ts", P, n=1).count() == 2
    end = F.timestamp_seconds(F.lit(10 * P + 30))
    still_open = alarms.heartbeat_gaps(df, ["s"], "ts", P, n=2, until=end).where("next_seen IS NULL").collect()
    assert still_open and all(r["missed_periods"] == 10 - r["last_seen"] // P - 1 for r in still_open)


def test_lag(spark, rows):
    records = spark.sql("SELECT 't' AS topic, p AS partition, o AS offset, timestamp_seconds(o) AS timestamp FROM VALUES (0, 5), (0, 9), (1, 3) AS v(p, o)")
    committed = spark.sql("SELECT 'g' AS consumer_group, 't' AS topic, p AS partition, o AS committed_offset, timestamp_seconds(o) AS committed_ts FROM VALUES (0, 5), (1, 3) AS v(p, o)")
    assert rows(metrics.lag_by_group(records, committed)) == [("g", "t", 0, 4, 4), ("g", "t", 1, 0, 0)]

def test_percentile_is_a_statistic(spark, rows):
    df = spark.range(101).selectExpr("'a' AS s", "timestamp_seconds(id % 2 * 60) AS ts", "CAST(id AS DOUBLE) AS value")
    got = metrics.metric(df, P, ["s"], {"n": "sample_count", "half": "p50", "top": "p100"})
    assert got.columns == ["s", "period_start", "n", "half", "top"]
    assert rows(got) == [("a", 0, 51, 50.0, 100.0), ("a", 60, 50, 50.0, 99.0)]
    assert rows(metrics.metric(df, P, ["s"], {"half": "p50"})) == [("a", 0, 50.0), ("a", 60, 50.0)]


def test_sketches_merge_and_roll_up(spark):
    values = spark.range(60_000).selectExpr(
        "timestamp_seconds(id) AS ts", "'s' || id % 3 AS s", "'k' || id % 2 AS k", "IF(id % 50 = 0, NULL, CAST(pow(id % 1009, 2) AS DOUBLE)) AS value"
    )
    made = sketches.sketched(values, 3600, ["s", "k"])
    assert made.count() == 17 * 6
    all_of = sketches.rolled_up(made, ["s", "k"], ["s", "k"])
    months = sketches.merged(all_of, ["s", "k"])
    fractions = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = sketches.percentiles(months, fractions)
    sizes = {(r.s, r.k): r.n for r in found.collect()}
    assert len(sizes) == 6 + 3 + 1 and sizes["All", "All"] == 58_800 and sizes["s0", "All"] == values.where("s = 's0' AND value IS NOT NULL").count()
    every = values.unionByName(values.withColumn("k", F.lit("All"))).unionByName(values.withColumns({"s": F.lit("All"), "k": F.lit("All")}))
    for r in sketches.rank_errors(found, every, ["s", "k"], "value", fractions).collect():
        assert all(r[p] <= sketches.RANK_ERROR for p in fractions), r
    # Bounded, however much a sketch has seen.
    assert months.select(F.max(F.length("sketch"))).first()[0] < 20_000


def test_rank_errors_are_distances(spark):
    values = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 2, 3, 4, 5, 6, 7, 8)], "s string, v double")
    found = spark.createDataFrame([("a", 2.0, 9.0)], "s string, p20 double, p50 double")
    error = sketches.rank_errors(found, values, ["s"], "v", {"p20": 0.2, "p50": 0.5}).first()
    assert error["p20"] == 0.0 and error["p50"] == 0.5


def weekly(spark, weeks, extra):
    """Hours of a week with busy working days; ``extra`` adds to single hours."""
    rows = []
    for h in range(weeks * 168):
        busy = h % 24 in range(8, 18) and h // 24 % 7 < 5
        rows.append(("a", h * 3600, (100.0 if busy else 10.0) + (h * 7 % 5) + extra.get(h, 0.0)))
    return spark.createDataFrame(rows, "s string, period_start bigint, v double")


def test_a_seasonal_band_follows_the_week(spark):
    from tidewatch.operators.alarms import anomaly_band
    from tidewatch.operators.seasonal import Season, seasonal_band, seasonal_states

    # Night hours of the last week with as much as a working hour has.
    odd = {6 * 168 + 2: 80.0, 6 * 168 + 3: 80.0, 6 * 168 + 30: 80.0}
    points = weekly(spark, 7, odd)
    season = Season(168, level=0.05, season=0.4, deviation=0.05, width=4.0)
    found = {r.period_start // 3600: r for r in seasonal_band(points, ["s"], "v", 3600, season).collect()}
    assert len(found) == 7 * 168 and all(found[h].upper is None for h in range(2 * 168)) and found[2 * 168].upper is not None
    assert {h for h, r in found.items() if r.breach and h >= 4 * 168} == set(odd)
    # The trailing mean takes every morning for an anomaly, and the night hours for none of a week's peaks.
    trailing = {r.period_start // 3600 for r in anomaly_band(points, ["s"], "v").where("breach").collect()}
    assert len([h for h in trailing if h >= 4 * 168 and h not in odd]) > 10
    alarms_found = seasonal_states(points, ["s"], "v", 3600, season).where("state = 'ALARM' AND period_start >= 4 * 168 * 3600")
    assert [r.period_start // 3600 for r in alarms_found.collect()] == [6 * 168 + 3]
    # What breaches is not learnt: the same hour a day later has the band it would have had.
    plain = {r.period_start // 3600: r for r in seasonal_band(weekly(spark, 7, {}), ["s"], "v", 3600, season).collect()}
    assert abs(found[6 * 168 + 26].upper - plain[6 * 168 + 26].upper) < 5


def test_a_seasonal_band_by_hand(spark):
    import math

    from tidewatch.operators.seasonal import Season, seasonal_band

    data = {"a": [4.0, 8.0, None, 9.0, 5.0, 8.0, 40.0, 9.0, None, 8.5], "b": [1.0] * 10, None: [2.0, None, 3.0]}
    rows = [(s, 100 * i, v) for s, vs in data.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "s string, period_start bigint, v double").repartition(3)
    got = {(r.s, r.period_start): (r.lower, r.upper, r.breach) for r in seasonal_band(df, ["s"], "v", 100, Season(2, 0.5, 0.25, 0.5, 2.0, 1)).collect()}
    for s, vs in data.items():
        level, seasons, spread = vs[0], [0.0, 0.0], 0.0
        assert got[s, 0] == (None, None, False)
        for i, v in list(enumerate(vs))[1:]:
            expected = level + seasons[i % 2]
            upper = expected + 2 * math.sqrt(spread) if i >= 2 else None
            breach = upper is not None and v is not None and v > upper
            low, high, flag = got[s, 100 * i]
            assert flag == breach and (upper is None) == (high is None) and (upper is None or abs(high - upper) < 1e-9 and abs(low + high - 2 * expected) < 1e-9)
            if v is not None and not breach:
                error = v - expected
                level, seasons[i % 2], spread = level + 0.5 * error, seasons[i % 2] + 0.25 * error, 0.5 * spread + 0.5 * error**2
    with pytest.raises(ValueError):
        Season(0)
