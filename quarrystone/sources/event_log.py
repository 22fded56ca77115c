"""An event log with offsets, written by Spark and read as a stream by a Python data source.

The log is a folder of segments; a segment holds the events of consecutive offsets, from the number in its name, as JSON lines.  A stream's offset is the
next event to be read.  Spark stores the offsets of each batch before it runs and commits them afterwards, so a restarted stream goes on
where the last finished batch ended, and a batch that is repeated reads the same events again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quarrystone.session import prepare
from quarrystone.store import Conflict, claim, children

FORMAT = "event_log"
#: Events of one Arrow batch.
ROWS = 8192


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def append_events(events: DataFrame, folder: str, order: str, body: str = "body") -> tuple[int, int]:
    """Append rows in ``order`` (their ``body`` is one JSON line each); returns the first and the next offset.

    Rows are dealt into ranges of ``order``; a range's first offset follows from the counts of the ranges before it, so no task sees all.  Of two
    writers that begin at the same offset one gets ``Conflict`` and has appended nothing.
    """
    spark = events.sparkSession
    first = end_offset(spark, folder)
    rows = events.select(F.col(order).alias("nth"), F.col(body).alias("body")).repartitionByRange("nth", F.xxhash64("body")).sortWithinPartitions("nth", F.xxhash64("body"))
    aside = f"{folder}/aside/{first:015d}-{uuid.uuid4().hex}"
    rows.withColumn("range", F.spark_partition_id()).select("range", "body").write.parquet(aside)
    stored = spark.read.parquet(aside)
    counts = sorted(stored.groupBy("range").count().collect())  # a row a range
    starts, at = {}, first
    for part, n in counts:
        starts[part], at = at, at + n
    if at == first:
        return first, first
    index = json.dumps({"first": first, "next": at, "data": aside, "ranges": sorted(starts.items())})
    if not claim(spark, f"{folder}/segments/{first:015d}", index):
        raise Conflict(f"other events were appended to {folder} at {first}")
    return first, at


def _indexes(spark: SparkSession, folder: str) -> list[str]:
    return [f"{folder}/segments/{name}" for name in children(spark, f"{folder}/segments") if name.isdigit()]


def end_offset(spark: SparkSession, folder: str) -> int:
    """The offset behind the last event."""
    found = _indexes(spark, folder)
    return json.loads(spark.read.text(found[-1], wholetext=True).first()[0])["next"] if found else 0


@dataclass
class Span(InputPartition):
    """The events ``skip`` to ``stop`` of one file's range, the first of which has the offset ``first``."""

    path: str
    range: int
    first: int
    skip: int
    stop: int


class EventLogReader(DataSourceStreamReader):
    """Offsets are {"next": n}; with ``most`` a batch has at most so many events."""

    def __init__(self, folder: str, most: int | None):
        self.folder, self.most = folder, most
        self.told: dict[int, dict] = {}
        self.at: int | None = None

    def _segments(self) -> list[dict]:
        """What the log holds now, in order; a segment's index never changes, so it is read once."""
        system, root = _opened(f"{self.folder}/segments")
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.isdigit() and int(info.base_name) not in self.told:
                with system.open_input_stream(info.path) as file:
                    self.told[int(info.base_name)] = json.loads(file.read())
        return [self.told[first] for first in sorted(self.told)]

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        end = max((s["next"] for s in self._segments()), default=0)
        # Where a batch may begin is only known once one was planned or committed; until then a batch may take all there is.
        if self.most and self.at is not None:
            end = min(end, self.at + self.most)
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.at = end["next"]
        spans = []
        for segment in self._segments():
            ranges = segment["ranges"]
            ends = [first for _, first in ranges[1:]] + [segment["next"]]
            for (number, first), stop in zip(ranges, ends, strict=True):
                low, high = max(first, start["next"]), min(stop, end["next"])
                if low < high:
                    spans.append(Span(segment["data"], number, first, low - first, high - first))
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, root = _opened(partition.path)
        rows = ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=True)
        at = 0
        for batch in rows.to_batches(columns=["body"], filter=ds.field("range") == partition.range, batch_size=ROWS, use_threads=False):
            low, high = max(partition.skip - at, 0), min(partition.stop - at, batch.num_rows)
            if low < high:
                some = batch.slice(low, high - low)
                offsets = pa.array(range(partition.first + at + low, partition.first + at + high), pa.int64())
                yield pa.RecordBatch.from_arrays([offsets, some.column(0).cast(pa.string())], names=["offset", "body"])
            at += batch.num_rows
            if at >= partition.stop:
                return

    def commit(self, end: dict) -> None:
        self.at = end["next"]


class EventLog(DataSource):
    """``spark.readStream.format("event_log").option("path", folder)``: (offset, body); option ``most`` bounds a batch."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "offset bigint, body string"

    def streamReader(self, schema) -> EventLogReader:
        return EventLogReader(self.options["path"], int(self.options.get("most", 0)) or None)


def event_stream(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(offset, body) of the log as a stream."""
    prepare(spark)
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).option("path", folder).option("most", str(most or 0)).load()
