"""A streaming source over record folders that is read from explicit offsets.

The log of a topic is a folder per partition with Parquet files of records. A
reader starts at a given offset in each partition, goes on from the offsets in
its checkpoint, and commits nothing to the log: several readers may be anywhere
in it at once.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "record-log"
SCHEMA = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
EARLIEST = "earliest"


def append_log(records: DataFrame, path: str) -> None:
    """Append records to the log at ``path``; files hold the records of one partition in the order of their offsets.

    Offsets of what is appended lie after those that the partition has. A
    partition that gets many records gets several files.
    """
    dealt = records.select("topic", "partition", "offset", "timestamp", "key", "value").repartitionByRange("topic", "partition", "offset")
    ordered = dealt.sortWithinPartitions("topic", "partition", "offset")
    ordered.write.mode("append").partitionBy("topic", "partition").parquet(path)


class _Files(InputPartition):
    """The records of one file between two offsets of its partition."""

    def __init__(self, file: str, partition: int, begin: int, end: int):
        super().__init__((partition, begin))
        self.file, self.partition, self.begin, self.end = file, partition, begin, end


class _LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.topic = options["path"], options["topic"]
        starting = options.get("startingoffsets", EARLIEST)
        self.starting = None if starting == EARLIEST else {int(p): int(o) for p, o in json.loads(starting).items()}
        self.spans: dict[str, tuple[int, int, int]] = {}

    def _store(self):
        """The file system of the path, which driver and workers reach alike."""
        from pyarrow import fs

        found, root = fs.FileSystem.from_uri(self.path if re.match(r"[a-z0-9]+:", self.path) else f"file://{self.path}")
        return found, f"{root.rstrip('/')}/topic={self.topic}"

    def _scan(self) -> dict[str, tuple[int, int, int]]:
        """Partition, first offset and end of every finished file; only footers of new files are read."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, root = self._store()
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            place = re.fullmatch(r"partition=(\d+)/[^._/][^/]*\.parquet", info.path[len(root) + 1 :])
            if info.type != fs.FileType.File or not place or info.path in self.spans:
                continue
            meta = pq.read_metadata(info.path, filesystem=store)
            at = meta.schema.names.index("offset")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
            if stats:
                self.spans[info.path] = (int(place[1]), min(s.min for s in stats), max(s.max for s in stats) + 1)
        return self.spans

    def initialOffset(self) -> dict:
        """Where the stream begins: the offsets asked for, or the first ones there are."""
        if self.starting is not None:
            return {str(p): o for p, o in sorted(self.starting.items())}
        first: dict[int, int] = {}
        for partition, begin, _ in self._scan().values():
            first[partition] = min(begin, first.get(partition, begin))
        return {str(p): o for p, o in sorted(first.items())}

    def latestOffset(self) -> dict:
        """One after the last record of every partition that is read; never before its start."""
        latest = dict(self.starting or {})
        for partition, _, end in self._scan().values():
            if self.starting is None or partition in self.starting:
                latest[partition] = max(end, latest.get(partition, 0))
        return {str(p): o for p, o in sorted(latest.items())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """One input partition per file with records in between."""
        parts = []
        for file, (partition, begin, stop) in sorted(self._scan().items()):
            low, high = start.get(str(partition), 0), end.get(str(partition), 0)
            if max(begin, low) < min(stop, high):
                parts.append(_Files(file, partition, max(begin, low), min(stop, high)))
        # A batch needs a partition even if nothing is in it.
        return parts or [_Files("", 0, 0, 0)]

    def read(self, partition: _Files) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if not partition.file:
            return
        store, _ = self._store()
        with store.open_input_file(partition.file) as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["key", "value", "offset", "timestamp"]):
                offset = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(offset, partition.begin), pc.less(offset, partition.end)))
                n = batch.num_rows
                if n:
                    times = batch.column("timestamp").cast(pa.timestamp("us", "UTC"))
                    topic, own = pa.array([self.topic] * n), pa.array([partition.partition] * n, pa.int32())
                    columns = [batch.column("key"), batch.column("value"), topic, own, batch.column("offset"), times]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "value", "topic", "partition", "offset", "timestamp"])

    def commit(self, end: dict) -> None:
        """Positions live in the checkpoint only."""


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _LogReader({k.lower(): v for k, v in self.options.items()})


def log_stream(spark: SparkSession, path: str, topic: str, offsets: dict[int, int] | None = None) -> DataFrame:
    """Records of a topic as a stream: of given partitions from given offsets on, or of all from their first.

    With explicit offsets only the partitions named are read. A restarted query
    goes on from its checkpoint whatever ``offsets`` say.
    """
    # The classes travel by value, so that workers need not find this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(RecordLog)
    starting = EARLIEST if offsets is None else json.dumps({str(p): o for p, o in offsets.items()})
    reader = spark.readStream.format(FORMAT).option("path", path).option("topic", topic).option("startingOffsets", starting)
    return reader.load()
