"""Topic semantics: ingestion, compaction and retention by age."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidewatch.sources.topics import decode, topic_parts

MAX_RETENTION_MS = 2_592_000_000
BUCKETS = 512  # rows of state that the keys of a compacted stream share
FOREVER = (1 << 53) // 1000  # the deadline of a live key, in seconds
_HELD = pa.schema([("topic", pa.string()), ("key", pa.string()), ("value", pa.string()), ("offset", pa.int64()), ("deadline", pa.int64())])


def parsed(records: DataFrame, schema: str) -> DataFrame:
    """Decoded records with the parts of their topic name; undecodable ones keep a NULL body."""
    parts = topic_parts(F.col("topic"))
    return decode(records, schema).select("*", *[c.alias(n) for n, c in parts.items()])


def compacted(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newest record per topic and key; a NULL value deletes its key.

    The newest one is a mergeable aggregate, so a hot key costs one row per task.
    """
    keys = keys or ["topic", "key"]
    others = [c for c in records.columns if c not in keys]
    newest = records.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("offset")).alias("_row"))
    return newest.select(*keys, "_row.*").where(F.col("value").isNotNull()).select(*records.columns)


def newest_per_key(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Compaction on a stream: changed keys with their newest value and offset.

    A key whose newest value is NULL is deleted; it must be put out, so that an
    older value goes. ``without_deleted`` drops it from the latest states.
    """
    newest = F.max_by(F.struct("value", "offset"), F.col("offset")).alias("_row")
    return stream.groupBy(*keys).agg(newest).select(*keys, "_row.value", "_row.offset")


def without_deleted(latest: DataFrame, value: str = "value") -> DataFrame:
    """The latest state of every key that was not deleted."""
    return latest.where(F.col(value).isNotNull())


def _compaction_function(seconds: int):
    def newest(key, rows, state: GroupState):
        """The newest offset and value of a key; a deleted key is forgotten after its life span."""
        held = best = state.get if state.exists else None
        for batch in rows:
            if batch.empty:  # a time-out brings no rows
                continue
            offsets = batch["offset"].to_numpy()
            at = int(offsets.argmax())
            offset, value = int(offsets[at]), batch["value"].iloc[at]
            if best is None or offset > best[0]:
                deadline = int(batch["seconds"].iloc[at]) + seconds if pd.isna(value) else None
                best = (offset, None if pd.isna(value) else value, deadline)
        now = state.getCurrentWatermarkMs()
        if best[2] is not None and best[2] * 1000 <= now:
            state.remove()
        else:
            if best is not held:
                state.update(best)
            if best[2] is not None:
                # A time-out comes when the watermark has passed it.
                state.setTimeoutTimestamp(max(best[2] * 1000 - 1, now))
        if best is not held:
            yield pd.DataFrame([(*key, best[1], best[0])], columns=["topic", "key", "value", "offset"])

    return newest


def _bucket_function(seconds: int):
    # Workers get these with the function, and need not have this package.
    def first_per_key(rows: pd.DataFrame) -> pd.DataFrame:
        """The newest row of every key; of equal offsets the first."""
        return rows.sort_values("offset", ascending=False, kind="stable").drop_duplicates(["topic", "key"])

    def packed(rows: pd.DataFrame) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_pandas(rows, _HELD, preserve_index=False))
        return sink.getvalue().to_pybytes()

    def newest(bucket, rows, state: GroupState):
        """As ``_compaction_function`` for all keys of a bucket at once, in one state row."""
        held = pa.ipc.open_stream(bytes(state.get[0])).read_all().to_pandas() if state.exists else None
        best = None
        for batch in rows:
            if batch.empty:
                continue
            # A part at a time, so that a hot key costs a row.
            batch = first_per_key(batch)
            best = batch if best is None else first_per_key(pd.concat([best, batch]))
        changed = None
        if best is not None:
            deadline = pd.Series(FOREVER, best.index, "int64")
            deleted = best["value"].isna()
            deadline[deleted] = best["seconds"][deleted].astype("int64") + seconds
            best = best[["topic", "key", "value", "offset"]].assign(deadline=deadline)
            if held is not None:
                both = first_per_key(pd.concat([held.assign(held=True), best.assign(held=False)]))
                changed, best = both[~both["held"]], both.drop(columns="held")
            else:
                changed = best
        now = state.getCurrentWatermarkMs()
        every = held if best is None else best
        kept = every[every["deadline"] * 1000 > now]
        if kept.empty:
            state.remove()
        else:
            if (changed is not None and len(changed)) or len(kept) < len(every):
                state.update((packed(kept),))
            first = int(kept["deadline"].min())
            if first < FOREVER:
                # A time-out comes when the watermark has passed it.
                state.setTimeoutTimestamp(max(first * 1000 - 1, now))
        if changed is not None and len(changed):
            yield changed[["topic", "key", "value", "offset"]]

    return newest


def compacted_stream(stream: DataFrame, delete_retention: int, late: int, buckets: int = BUCKETS) -> DataFrame:
    """Compaction per topic and key with a life span for deletes: changed keys with their newest value and offset.

    A NULL value deletes its key: it is put out once, so that the older value
    goes, and held for ``delete_retention`` seconds of event time after its own
    timestamp; then the key leaves the state. Records that come after a newer one
    of their key change nothing. A record older than the watermark, ``late``
    seconds behind the newest of all, is dropped, so a forgotten key comes back
    by newer records only. State holds live keys and recent deletes, those of a
    bucket of keys in one row, since a call for each key costs about a
    millisecond; a micro-batch writes the buckets anew that it changes. Their
    number stays with the checkpoint; 0 gives each key a row.
    """
    if delete_retention < late:
        raise ValueError("deletes are kept at least as long as records may be late")
    timed = stream.select(
        "topic", "key", "value", "offset", F.unix_seconds("timestamp").alias("seconds"), F.col("timestamp").alias("_event_time")
    ).withWatermark("_event_time", f"{late} seconds")
    out = "topic string, key string, value string, offset long"
    if not buckets:
        grouped, newest, held = timed.groupBy("topic", "key"), _compaction_function(delete_retention), "offset long, value string, deadline long"
    else:
        dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("topic", "key"), F.lit(buckets)))
        grouped, newest, held = dealt.groupBy("bucket"), _bucket_function(delete_retention), "held binary"
    return grouped.applyInPandasWithState(newest, out, held, "update", "EventTimeTimeout")


def retained_by_age(records: DataFrame, retention_ms: int) -> DataFrame:
    """Records at most ``retention_ms`` older than the newest; -1 keeps all."""
    if retention_ms == -1:
        return records
    if not 0 <= retention_ms <= MAX_RETENTION_MS:
        raise ValueError(f"retention is -1 or 0 to {MAX_RETENTION_MS} ms")
    newest = records.agg(F.max(F.unix_millis("timestamp"))).scalar()
    return records.where(F.unix_millis("timestamp") >= newest - F.lit(retention_ms))
