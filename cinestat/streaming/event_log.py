"""A segmented event log and a streaming reader with offsets.

The log is a folder of Parquet segments. Every event has a partition, by its key,
and an offset, one after the other in its partition; an append writes segments
and then, in one file, which offsets they hold. Only what that list names exists,
so a failed append leaves nothing to read.

``EventLog`` is a Python data source (``spark.readStream.format("event_log")``).
It starts at the ``earliest`` or ``latest`` offsets, reads each partition's new
segments as Arrow batches in tasks of their own, and resumes from the query's
checkpoint. It is a table with offsets, no broker: there is no process to run.

Options: ``path``; ``startingOffsets`` (``latest``, the default, or
``earliest``). A batch takes what there is: the engine asks a Python source for
its end before it tells it the start, so a batch cannot be limited from here.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset long, value string"
_SEGMENTS = "partition int, first long, last long, file string"
SEGMENT_ROWS = 200_000


def _ends(segments: DataFrame) -> DataFrame:
    return segments.groupBy("partition").agg((F.max("last") + 1).alias("next"))


def append_events(events: DataFrame, path: str, key: Column, order: Sequence[str], partitions: int = 8) -> None:
    """Append ``events`` (value and the columns of ``order``) to the log; within a
    partition the offsets follow ``order``, which must be unique per event."""
    spark = events.sparkSession
    spark.createDataFrame([], _SEGMENTS).write.mode("ignore").parquet(f"{path}/list")
    known = spark.read.schema(_SEGMENTS).parquet(f"{path}/list")
    at = F.coalesce(F.col("next"), F.lit(0)) + F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1
    rows = (events.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
            .join(F.broadcast(_ends(known)), "partition", "left")  # one row a partition
            .select("partition", at.alias("offset"), "value"))
    folder = f"{path}/segments/{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    (rows.repartition(partitions, "partition").sortWithinPartitions("partition", "offset")
     .withColumn("part", F.col("partition")).write.partitionBy("part").option("maxRecordsPerFile", SEGMENT_ROWS).parquet(folder))
    made = (spark.read.parquet(folder).groupBy("partition", F.col("_metadata.file_path").alias("file"))
            .agg(F.min("offset").alias("first"), F.max("offset").alias("last")))
    made.select("partition", "first", "last", "file").coalesce(1).write.mode("append").parquet(f"{path}/list")


def _listed(path: str) -> list[dict]:
    """The segments that exist, a row each."""
    system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/list")) if f.path.endswith(".parquet")]
    return [r for f in files for r in pq.read_table(f, filesystem=system).to_pylist()]


@dataclass
class Range(InputPartition):
    """Offsets ``first`` to ``last`` of one partition, and the files they lie in."""

    number: int
    first: int
    last: int
    files: list[str] = field(default_factory=list)


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start = options.get("startingOffsets", "latest")
        if self.start not in ("latest", "earliest"):
            raise ValueError(f"startingOffsets: {self.start}")

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.start == "latest" else {}

    def latestOffset(self) -> dict:
        out: dict[str, int] = {}
        for s in _listed(self.path):
            out[str(s["partition"])] = max(out.get(str(s["partition"]), 0), s["last"] + 1)
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        segments = _listed(self.path)
        out = []
        for p, last in end.items():
            first = start.get(p, 0)
            files = [s["file"] for s in segments if str(s["partition"]) == p and s["last"] >= first and s["first"] < last]
            if files:
                out.append(Range(int(p), first, last - 1, sorted(files)))
        return out or [Range(0, 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for f in partition.files:
            system, at = fs.FileSystem.from_uri(f)
            table = pq.ParquetFile(at, filesystem=system)
            for batch in table.iter_batches(columns=["partition", "offset", "value"]):
                offset = batch.column("offset").to_numpy()
                yield batch.filter(pa.array((offset >= partition.first) & (offset <= partition.last)))

    def commit(self, end: dict) -> None:
        """Nothing to keep: the query's checkpoint has the offsets."""


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogReader(self.options)


def log_source(spark: SparkSession, path: str, starting: str = "latest") -> DataFrame:
    """The log as a stream of partition, offset, value."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").option("path", path).option("startingOffsets", starting).load()
