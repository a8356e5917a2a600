import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alarms, metrics
from tidewatch.streaming import alarms as live
from tidewatch.sources import record_log
from tidewatch.streaming import late, routing, runs, topics
from tidewatch.streaming.metrics import batch_round_trips, round_trips, unique_within, windowed

EVENTS = "id bigint, s string, ts timestamp, v double"


def events(spark, data):
    rows = [(i, s, float(v)) + (t,) for i, s, t, v in data]
    return spark.createDataFrame(rows, "id bigint, s string, v double, t bigint").select(
        "id", "s", F.timestamp_seconds("t").alias("ts"), "v"
    )


def write(df, path, name):
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, schema=EVENTS, files=1):
    return runs.file_stream(spark, f"{path}/*", schema, files)


def test_windows_over_two_batches(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(events(spark, [(1, "a", 5, 1), (2, "a", 65, 2)]), path, "1")

    def run():
        counted = windowed(stream(spark, path), "ts", 60, ["s"], [F.count(F.lit(1)).alias("n")])
        return runs.latest_update(runs.update_available(counted, out), ["s", "period_start"])

    assert rows(run()) == [("a", 0, 1), ("a", 60, 1)]
    # A restart goes on where it stopped: nothing is counted twice, and 1000 s later rows come too late.
    write(events(spark, [(3, "a", 61, 1), (4, "a", 1000, 1)]), path, "2")
    assert rows(run()) == [("a", 0, 1), ("a", 60, 2), ("a", 960, 1)]
    write(events(spark, [(5, "a", 70, 1)]), path, "3")
    assert rows(run()) == [("a", 0, 1), ("a", 60, 2), ("a", 960, 1)]


def test_append_is_not_repeated(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(events(spark, [(1, "a", 5, 1), (2, "b", 6, 1)]), path, "1")
    for _ in range(2):
        got = runs.append_available(stream(spark, path), out)
    assert got.count() == 2


def test_redelivered_records_are_dropped(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    write(events(spark, [(1, "a", 5, 1), (1, "a", 5, 1), (2, "b", 6, 1)]), path, "1")
    write(events(spark, [(1, "a", 5, 1), (3, "b", 9, 1)]), path, "2")
    got = runs.append_available(unique_within(stream(spark, path), "ts", ["id"], 600), str(tmp_path / "out"))
    assert rows(got, "id") == [(1,), (2,), (3,)]


def test_round_trips_in_both_forms(spark, rows, tmp_path):
    sent = events(spark, [(1, "a", 100, 0), (2, "a", 110, 0), (3, "a", 120, 0), (4, "a", 130, 0), (9, "end", 5000, 0)])
    received = events(spark, [(1, "a", 100, 0), (2, "a", 145, 0), (2, "a", 140, 0), (3, "a", 156, 0), (9, "end", 5000, 0)])
    wanted = [(1, "pass"), (2, "pass"), (3, "fail"), (4, "fail"), (9, "pass")]
    batch = batch_round_trips(sent, received, "id")
    assert rows(batch, "id", "status") == wanted
    first = batch.where("id = 2").select(F.unix_seconds("received_at")).first()[0]
    assert first == 140
    write(sent, str(tmp_path / "sent"), "1")
    write(received, str(tmp_path / "received"), "1")
    live_rows = runs.append_available(
        round_trips(stream(spark, str(tmp_path / "sent")), stream(spark, str(tmp_path / "received")), "id"), str(tmp_path / "out")
    )
    assert sorted(set(rows(live_rows, "id", "status"))) == wanted


@pytest.mark.parametrize("silence", [False, True])
@pytest.mark.parametrize("missing", ["breaching", "notBreaching"])
@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_streaming_alarm_equals_batch(spark, rows, tmp_path, missing, silence, order):
    rng = random.Random(11)
    # A stream's watermark begins at the epoch, so the data begin after it.
    data = [(s, p * 60, rng.choice([0.0, 9.0])) for s in "abc" for p in range(5, 45 if s != "b" else 33) if rng.random() < 0.6]
    points = spark.createDataFrame(data, "s string, period_start bigint, v double")
    alarm = alarms.Alarm(">=", 5, n=3, m=2, missing=missing)
    path = str(tmp_path / "in")
    ranges = [(0, 900), (900, 1500), (1500, 9999)]
    for i, (low, high) in enumerate(ranges[i] for i in order):
        write(points.where(F.col("period_start").between(low, high - 1)), path, str(i))
    # In order the watermark may follow closely; otherwise it waits for the whole span.
    late = 0 if order == (0, 1, 2) else 6000
    write(live.closing_point(points, "s", late), path, "9")
    changes = live.alarm_transitions(stream(spark, path, points.schema), "s", "v", 60, alarm, late=late, silence=silence)
    got = runs.append_available(changes, str(tmp_path / "out"))
    newest = max(at for _, at, _ in data)
    expected = []
    for name in "abc":
        own = points.where(F.col("s") == name)
        last = max(at for s, at, _ in data if s == name)
        filled = metrics.fill_periods(own, ["s"], 60, {}, last=min(last + 3 * 60, newest) if silence else last, first=0)
        filled = filled.where(F.col("period_start") >= min(at for s, at, _ in data if s == name))
        expected += rows(
            alarms.transitions(alarms.alarm_states(filled, ["s"], "v", alarm), ["s"]), "s", "period_start", "previous_state", "state"
        )
    assert sorted(rows(got, "series", "period_start", "previous_state", "state")) == sorted(expected)
    assert expected


def points_of(spark, data):
    return spark.createDataFrame(data, "s string, period_start bigint, v double")


def test_alarm_waits_for_the_watermark_and_goes_on(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    alarm = alarms.Alarm(">=", 5, n=2, m=2, missing="breaching")

    def run():
        changes = live.alarm_transitions(stream(spark, path, "s string, period_start bigint, v double"), "s", "v", 60, alarm, late=120)
        return rows(runs.append_available(changes, out))

    # 840 is seen before 780; with 120 s to wait, nothing after 720 is final yet.
    write(points_of(spark, [("a", 600, 9.0), ("a", 720, 9.0), ("a", 840, 0.0), (None, 660, 1.0)]), path, "1")
    assert run() == [("a", 660, "OK", "ALARM")]
    # 780 comes late but in time, twice, and breaches once; 660 comes too late to matter.
    write(points_of(spark, [("a", 780, 0.0), ("a", 780, 9.0), ("a", 660, 0.0)]), path, "2")
    write(points_of(spark, [("b", 1000, 0.0)]), path, "3")
    assert run() == [("a", 660, "OK", "ALARM"), ("a", 840, "ALARM", "OK")]


def test_periods_are_filled_when_their_time_has_come(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        filled = live.filled_stream(stream(spark, path, "s string, period_start bigint, v double"), "s", "v", 60, -1.0, late=60)
        return rows(runs.append_available(filled, out))

    write(points_of(spark, [("a", 120, 1.0), ("b", 240, 2.0)]), path, "1")
    first = [("a", 120, 1.0, False), ("a", 180, -1.0, True)]
    assert run() == first
    # a is silent, b goes on: a's periods are put out all the same, up to the watermark.
    write(points_of(spark, [("b", 420, 3.0), ("b", 300, 4.0)]), path, "2")
    more = [("a", p, -1.0, True) for p in (240, 300, 360)] + [("b", 240, 2.0, False), ("b", 300, 4.0, False), ("b", 360, -1.0, True)]
    assert sorted(run()) == sorted(first + more)


def test_late_rows_are_counted(spark, rows, tmp_path):
    path, out, kept = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "metrics")
    for name, data in (("1", [(1, "a", 1000, 0), (2, "a", 2000, 0)]), ("2", [(3, "a", 5, 0), (4, "a", 1990, 0), (5, "b", 1899, 0), (5, "b", 1901, 0)])):
        write(events(spark, data), path, name)
        with late.late_rows(spark, kept):
            runs.append_available(unique_within(stream(spark, path), "ts", ["id"], 100), out, name="watched")
    assert rows(late.dropped_rows(spark, kept).where("dropped > 0"), "query", "operator", "kind", "dropped") == [
        ("watched", 0, "dedupeWithinWatermark", 2)
    ]
    # A batch that drops nothing says so.
    assert late.dropped_rows(spark, kept).where("dropped = 0").count() >= 2


def test_routed_batches_are_not_doubled(spark, rows, tmp_path):
    from tidewatch.sources.catalog import ensure_database

    ensure_database(spark, "routing_test", str(tmp_path / "db"))
    columns = [{"name": "id", "type": "bigint"}, {"name": "v", "type": "double"}]
    router = routing.Router(spark, "routing_test", str(tmp_path / "tables"), columns, ["a-1", "b"]).create()
    batch = events(spark, [(1, "a-1", 5, 1), (2, "b", 6, 2), (3, "c", 7, 3), (4, None, 8, 4)])
    for _ in range(2):
        router.write(batch, F.col("s"), 0)
    router.write(events(spark, [(5, "b", 9, 5)]), F.col("s"), 1)
    assert rows(router.rows("a-1"), "id", "v") == [(1, 1.0)]
    assert rows(router.rows("b"), "id", "_batch") == [(2, 0), (5, 1)]
    assert rows(router.rows(routing.UNROUTED), "id", "event") == [(3, "c"), (4, None)]
    for wrong in (["a b"], ["x.y", "x-y"]):
        with pytest.raises(ValueError):
            routing.Router(spark, "routing_test", str(tmp_path / "t2"), columns, wrong)


def test_routing_retries_a_batch_that_failed(spark, rows, tmp_path):
    from tidewatch.sources.catalog import ensure_database

    ensure_database(spark, "routing_retry", str(tmp_path / "db"))
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    write(events(spark, [(1, "a", 5, 1), (2, "b", 6, 2)]), path, "1")
    router = routing.Router(spark, "routing_retry", str(tmp_path / "tables"), [{"name": "id", "type": "bigint"}], ["a", "b"])
    whole = router.write

    def broken(batch, event, number):
        whole(batch, event, number)
        raise RuntimeError("lost after the write")

    router.write = broken
    with pytest.raises(Exception, match="lost after the write"):
        router.run_available(stream(spark, path), F.col("s"), checkpoint)
    router.write = whole
    write(events(spark, [(3, "a", 9, 1)]), path, "2")
    router.run_available(stream(spark, path), F.col("s"), checkpoint)
    assert rows(router.rows("a"), "id") == [(1,), (3,)] and rows(router.rows("b"), "id") == [(2,)]


def test_absence_is_reported_once(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    # a is silent for 3 periods between batches, b stays silent, c never is.
    write(events(spark, [(1, "a", 10, 0), (1, "a", 11, 0), (2, "b", 20, 0), (3, "c", 30, 0)]), path, "1")
    write(events(spark, [(4, "c", 70 + 60 * i, 0) for i in range(2)]), path, "2")
    write(events(spark, [(5, "a", 250, 0)] + [(4, "c", 190 + 60 * i, 0) for i in range(8)]), path, "3")
    silent = live.absences(stream(spark, path), "s", "ts", 60, n=2)
    got = runs.append_available(silent, str(tmp_path / "out"), large_state=True)
    assert rows(got) == [("a", 0, 180), ("a", 240, 420), ("b", 0, 180)]


def records(spark, data):
    return spark.createDataFrame(
        data, "key string, value string, topic string, partition int, offset bigint, t bigint"
    ).select("key", "value", "topic", "partition", "offset", F.timestamp_seconds("t").alias("timestamp"))


def test_compaction_drops_deleted_keys(spark, rows):
    df = records(spark, [("a", "1", "t", 0, 1, 1), ("a", None, "t", 0, 2, 2), ("b", "1", "t", 0, 3, 3), ("b", "2", "t", 0, 4, 1), ("a", "9", "u", 0, 1, 1)])
    assert rows(topics.compacted(df), "topic", "key", "value") == [("t", "b", "2"), ("u", "a", "9")]


def test_retention_by_age(spark, rows):
    df = records(spark, [("a", "1", "t", 0, i, t) for i, t in enumerate([0, 50, 100])])
    assert rows(topics.retained_by_age(df, 50_000), "offset") == [(1,), (2,)]
    assert topics.retained_by_age(df, -1).count() == 3
    assert rows(topics.retained_by_age(df, 0), "offset") == [(2,)]
    for wrong in (-2, topics.MAX_RETENTION_MS + 1):
        with pytest.raises(ValueError):
            topics.retained_by_age(df, wrong)


def test_compaction_on_a_stream(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
    write(records(spark, [("a", "1", "t", 0, 1, 1), ("b", "1", "t", 0, 2, 1)]), path, "1")
    write(records(spark, [("a", "2", "t", 0, 3, 2)]), path, "2")
    newest = topics.newest_per_key(stream(spark, path, schema), ["topic", "key"])
    got = runs.latest_update(runs.update_available(newest, out), ["topic", "key"])
    assert rows(got, "key", "value", "offset") == [("a", "2", 3), ("b", "1", 2)]


def test_deletes_leave_the_state(spark, rows, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
    states = []

    def run(name, data):
        write(records(spark, data), path, name)
        changed = topics.compacted_stream(stream(spark, path, schema), delete_retention=100, late=10)
        writer = changed.writeStream.outputMode("update").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
        with runs._large_state(spark, True):
            query = writer.foreachBatch(lambda batch, n: batch.withColumn("run", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
        query.awaitTermination()
        states.append(query.lastProgress.stateOperators[0].numRowsTotal)
        found = spark.read.schema("topic string, key string, value string, offset bigint, batch bigint").parquet(out)
        return rows(topics.without_deleted(runs.latest_update(found, ["topic", "key"])), "key", "value", "offset")

    assert run("1", [("a", "1", "t", 0, 1, 100), ("b", "1", "t", 0, 2, 100), ("c", "1", "t", 0, 3, 100)]) == [("a", "1", 1), ("b", "1", 2), ("c", "1", 3)]
    # Two deletes, one of them undone by a newer value; an older record changes nothing.
    assert run("2", [("a", None, "t", 0, 5, 110), ("b", None, "t", 0, 6, 110), ("b", "2", "t", 0, 7, 111), ("c", "0", "t", 0, 2, 109)]) == [("b", "2", 7), ("c", "1", 3)]
    held = states[-1]
    assert run("3", [("d", "1", "t", 0, 8, 300)]) == [("b", "2", 7), ("c", "1", 3), ("d", "1", 8)]
    # a and its timer are gone, d is there.
    assert states[-1] < held + 1
    # A forgotten key comes back by a newer record.
    assert run("4", [("a", "9", "t", 0, 9, 310)]) == [("a", "9", 9), ("b", "2", 7), ("c", "1", 3), ("d", "1", 8)]
    with pytest.raises(ValueError):
        topics.compacted_stream(stream(spark, path, schema), delete_retention=5, late=10)


def test_log_is_read_from_explicit_offsets(spark, rows, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    data = [("k", str(i), "t", p, i, i) for p in range(3) for i in range(10)] + [("k", "x", "other", 0, 0, 0)]
    record_log.append_log(records(spark, data), path)

    def run(target, offsets):
        return rows(runs.append_available(record_log.log_stream(spark, path, "t", offsets), target), "partition", "offset", "value")

    first = [(p, i, str(i)) for p, start in ((0, 7), (2, 4)) for i in range(start, 10)]
    assert run(out, {0: 7, 2: 4}) == first
    assert run(out, {0: 7, 2: 4}) == first
    # Partition 1 grows, too, but is not read; the start given again is not heeded.
    record_log.append_log(records(spark, [("k", "n", "t", p, i, i) for p in range(3) for i in (10, 11)]), path)
    assert sorted(run(out, {0: 0, 2: 0})) == sorted(first + [(p, i, "n") for p in (0, 2) for i in (10, 11)])
    # Another reader from the beginning is not held up by the first one.
    assert len(run(str(tmp_path / "all"), None)) == 36
    # A start beyond the end waits for its offset.
    assert run(str(tmp_path / "far"), {0: 13}) == []
    record_log.append_log(records(spark, [("k", "n", "t", 0, i, i) for i in (12, 13, 14)]), path)
    assert run(str(tmp_path / "far"), {0: 13}) == [(0, 13, "n"), (0, 14, "n")]
    times = spark.read.parquet(str(tmp_path / "all")).where("partition = 0 AND offset = 11").select(F.unix_seconds("timestamp")).first()[0]
    assert times == 11


class OneState:
    """Stands for the state of one series and counts what is asked of it."""

    def __init__(self, watermark):
        self.exists, self.get, self.watermark, self.writes, self.timeout = False, None, watermark, 0, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get, self.writes = True, value, self.writes + 1

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def test_open_periods_take_one_write_and_one_timeout():
    # Every period used to cost several calls to the state store and a timer of its own.
    batch = pd.DataFrame({"period_start": range(60, 60_060, 60), "value": [1.0] * 1000, "breach": [False] * 1000})
    for make in (lambda: live._filling_function(60, 0.0), lambda: live._alarm_function(3, 2, 60, True, False)):
        state = OneState(0)
        assert list(make()(("a",), iter([batch]), state)) == []
        assert (state.writes, state.timeout) == (1, 59_999)
        state.watermark = 600_000
        found = list(make()(("a",), iter([]), state))
        assert state.writes == 2 and state.timeout == 659_999
        assert sum(len(f) for f in found) in (0, 10)


def test_landed_points_come_in_few_files(spark, tmp_path):
    from glob import glob

    from tidewatch.queries.streams import POINT_FILES, land_points

    points = spark.range(400).select(F.col("id").alias("s"), (F.col("id") * 60).alias("period_start")).repartition(40)
    land_points(points, "s", str(tmp_path / "points"))
    assert 1 < len(glob(str(tmp_path / "points/part=0/*.parquet"))) <= POINT_FILES
    assert len(glob(str(tmp_path / "points/part=1/*.parquet"))) == 1


def test_a_compacted_key_takes_one_write_and_no_timer_of_its_own():
    state = OneState(0)
    batch = pd.DataFrame({"offset": [3, 5, 4], "value": ["x", None, "y"], "seconds": [10, 20, 30]})
    found = list(topics._compaction_function(100)(("t", "a"), iter([batch]), state))
    assert [tuple(f.iloc[0]) for f in found] == [("t", "a", None, 5)]
    assert (state.writes, state.get, state.timeout) == (1, (5, None, 120), 119_999)
    # An older record changes nothing.
    older = pd.DataFrame({"offset": [2], "value": ["z"], "seconds": [5]})
    assert list(topics._compaction_function(100)(("t", "a"), iter([older]), state)) == [] and state.writes == 1


def test_joined_streams_keep_one_store(spark, tmp_path):
    """Both sides of a join share a store, and the session's settings are left as they were."""
    spark.createDataFrame([(1, 100), (2, 200)], "id long, at long").selectExpr("id", "timestamp_seconds(at) AS ts").write.parquet(str(tmp_path / "in"))
    sides = [runs.file_stream(spark, str(tmp_path / "in"), "id long, ts timestamp") for _ in range(2)]
    before = [spark.conf.get(name, None) for name in runs.JOIN_STATE]
    got = runs.append_available(round_trips(*sides, "id"), str(tmp_path / "out"), join=True)
    assert {(r.id, r.status) for r in got.collect()} == {(1, "pass"), (2, "pass")}
    assert [spark.conf.get(name, None) for name in runs.JOIN_STATE] == before
    assert not list((tmp_path / "out-checkpoint" / "state").glob("0/0/left-*"))


def test_keys_of_a_bucket_share_a_state_row():
    state = OneState(0)
    state.remove = lambda: state.__dict__.update(exists=False, get=None)
    n = 1000
    batch = pd.DataFrame({"topic": "t", "key": [f"k{i % n}" for i in range(2 * n)], "value": ["x"] * (2 * n - 1) + [None], "offset": range(2 * n), "seconds": 10})
    newest = topics._bucket_function(100)
    found = pd.concat(newest((1,), iter([batch[:900], batch[900:]]), state))
    assert (len(found), found["offset"].min(), state.writes, state.timeout) == (n, n, 1, 109_999)
    assert found["key"][found["value"].isna()].tolist() == [f"k{n - 1}"]
    # Older records, and others with an offset that is held, change nothing.
    assert list(newest((1,), iter([batch[:n].assign(value="z"), batch[n:].assign(value="z")]), state)) == [] and state.writes == 1
    # The delete leaves the state with the watermark, and its key comes back by any record.
    state.watermark = 110_000
    assert list(newest((1,), iter([]), state)) == [] and state.writes == 2
    late = pd.DataFrame({"topic": "t", "key": [f"k{n - 1}", "k0"], "value": ["y", "y"], "offset": [5, 5], "seconds": 111})
    assert [f.values.tolist() for f in newest((1,), iter([late]), state)] == [[["t", f"k{n - 1}", "y", 5]]]
    # A bucket of expired deletes is forgotten.
    gone = OneState(500_000)
    gone.remove = lambda: gone.__dict__.update(exists=False, get="removed")
    assert len(pd.concat(newest((1,), iter([batch.tail(1)]), gone))) == 1 and gone.get == "removed"


@pytest.mark.parametrize("buckets", [0, 3])
def test_compacted_stream_by_bucket_and_by_key(spark, rows, tmp_path, buckets):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
    last = {}
    for n in range(3):
        data = [(None if i % 11 == 0 else f"k{i % 11}", None if i % 5 == n else str(n), f"t{i % 2}", 0, 100 * n + i, 10 * n) for i in range(40)]
        last |= {(topic, key): (value, offset) for key, value, topic, _, offset, _ in data}
        write(records(spark, data), path, str(n))
        changed = topics.compacted_stream(stream(spark, path, schema), delete_retention=100, late=50, buckets=buckets)
        got = runs.latest_update(runs.update_available(changed, out), ["topic", "key"])
    want = [(t, k, *v) for (t, k), v in last.items()]
    assert rows(got, "topic", "key", "value", "offset") == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))
