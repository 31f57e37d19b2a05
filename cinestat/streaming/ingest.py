"""Structured Streaming ingest of rating events.

JSON events arrive as text (a Kafka ``value`` or a line in a file). They are
parsed with a fixed schema that accepts both producer spellings, malformed
events go to a dead-letter sink, valid events are appended to Parquet with a
checkpoint (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinestat import schemas as S

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType(), True)] + list(S.RATING_EVENT.fields))

INGESTED = T.StructType([
    T.StructField("event_id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("movie_id", T.LongType(), True),
    T.StructField("rating", T.DoubleType(), True),
    T.StructField("ts_text", T.StringType(), True),
])


def kafka_source(spark: SparkSession, bootstrap_servers: str, topic: str,
                 starting_offsets: str = "latest") -> DataFrame:
    """Kafka stream of event bytes (S5, T6). Needs the Kafka connector on the
    classpath; the query's checkpoint takes the role of a consumer group."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .load()
            .select(F.col("value").cast("string").alias("value")))


def file_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON lines from files in ``path`` (stand-in for Kafka)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def parse_events(raw: DataFrame, value_col: str = "value") -> DataFrame:
    """value text -> event fields + ``_valid``.

    ``user_id`` falls back to ``userId``, the time text to ``date``. An event
    is valid when it is JSON, has a user and a movie, and its time, if it has
    one, can be read: an unreadable time goes to the rejects, where it is seen,
    and not into the sink, where later steps could only drop it."""
    p = F.from_json(F.col(value_col).cast("string"), EVENT_SCHEMA)
    parsed = raw.select(F.col(value_col).cast("string").alias("value"), p.alias("e"))
    e = F.col("e")
    user = F.coalesce(e["user_id"], e["userId"])
    when = F.coalesce(e["timestamp"], e["date"])
    valid = (e.isNotNull() & user.isNotNull() & e["movieId"].isNotNull()
             & (when.isNull() | event_time(when).isNotNull()))
    return parsed.select(
        "value",
        e["event_id"].alias("event_id"),
        user.alias("user_id"),
        e["movieId"].alias("movie_id"),
        e["rating"].alias("rating"),
        when.alias("ts_text"),
        F.coalesce(valid, F.lit(False)).alias("_valid"))


# ISO forms of an event time: with and without seconds, zone and fraction
_ISO = r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:?\d\d)?)?$"


def event_time(ts_text: Column) -> Column:
    """Event time from ISO text, with or without a fraction of a second, or a
    bare date (midnight); NULL for anything else. Text without a zone is UTC,
    the session's zone."""
    return F.when(ts_text.rlike(_ISO), ts_text.try_cast("timestamp"))


def start_ingest(raw: DataFrame, sink: str, rejects: str, checkpoint: str, available_now: bool = True,
                 processing_time: str | None = None):
    """Start the two append queries (valid -> sink, malformed -> rejects).

    Returns both StreamingQuery handles. Each has its own checkpoint under
    ``checkpoint`` so a restart resumes where it stopped."""
    parsed = parse_events(raw)

    def start(df, path, name):
        w = (df.writeStream.format("parquet").outputMode("append")
             .option("path", path).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}"))
        if available_now:
            w = w.trigger(availableNow=True)
        elif processing_time:
            w = w.trigger(processingTime=processing_time)
        return w.start()

    good = parsed.filter("_valid").select(*[f.name for f in INGESTED.fields])
    bad = parsed.filter(~F.col("_valid")).select("value", F.current_timestamp().alias("rejected_at"))
    return start(good, sink, "events"), start(bad, rejects, "rejects")


def run_ingest(spark: SparkSession, source_dir: str, sink: str, rejects: str, checkpoint: str) -> None:
    """Process everything in ``source_dir`` once (availableNow) and stop."""
    qs = start_ingest(file_source(spark, source_dir), sink, rejects, checkpoint)
    for q in qs:
        q.awaitTermination()
        if q.exception():
            raise q.exception()


BATCHES = "batch_id long, n_rows long"


def reject_reason(value: Column, parsed: Column) -> Column:
    """Why a malformed event was turned away."""
    user = F.coalesce(parsed["user_id"], parsed["userId"])
    return (F.when(value.isNull() | parsed.isNull() | ~F.ltrim(value).startswith("{"), "not_json").when(user.isNull(), "no_user")
            .when(parsed["movieId"].isNull(), "no_movie").otherwise("bad_time"))


class AtomicSink:
    """Valid and rejected events of a stream in one table, written batch by batch.

    A batch is parsed once and written by one job to a folder of its own, parted
    by validity and event date; then its number is added to the table of commits.
    Readers take committed batches only. A batch that is repeated after a failure
    overwrites its folder, or does nothing if it had been committed: no row is
    lost, doubled or seen without the others of its batch, valid or rejected."""

    ROWS = T.StructType([*INGESTED.fields, T.StructField("value", T.StringType()), T.StructField("reason", T.StringType()),
                         T.StructField("rejected_at", T.TimestampType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.data, self.commits = spark, f"{path}/data", f"{path}/commits"

    def open(self) -> None:
        """An empty table of commits, if there is none."""
        self.spark.createDataFrame([], BATCHES).write.mode("ignore").parquet(self.commits)

    def committed(self) -> DataFrame:
        return self.spark.read.schema(BATCHES).parquet(self.commits)

    def write(self, raw: DataFrame, batch_id: int) -> None:
        """One batch (``foreachBatch``)."""
        if not self.committed().where(F.col("batch_id") == batch_id).isEmpty():
            return
        rows = parse_events(raw)
        out = rows.withColumn("reason", F.when(~F.col("_valid"), reject_reason(F.col("value"), F.from_json("value", EVENT_SCHEMA)))) \
            .select(*[f.name for f in INGESTED.fields], F.when(~F.col("_valid"), F.col("value")).alias("value"), "reason",
                    F.when(~F.col("_valid"), F.current_timestamp()).alias("rejected_at"), F.col("_valid").alias("valid"),
                    F.to_date(event_time(F.col("ts_text"))).alias("event_date"))
        out.write.mode("overwrite").partitionBy("valid", "event_date").parquet(f"{self.data}/batch_id={batch_id}")
        self.commit(batch_id)

    def commit(self, batch_id: int) -> None:
        n = self._table().where(F.col("batch_id") == batch_id).agg(F.lit(batch_id).cast("long").alias("batch_id"),
                                                                   F.count(F.lit(1)).alias("n_rows"))
        n.write.mode("append").parquet(self.commits)

    def _table(self) -> DataFrame:
        full = T.StructType([*self.ROWS.fields, T.StructField("batch_id", T.LongType()), T.StructField("valid", T.BooleanType()),
                             T.StructField("event_date", T.DateType())])
        return self.spark.read.schema(full).option("basePath", self.data).parquet(self.data)

    def _read(self, valid: bool) -> DataFrame:
        if self.committed().isEmpty():
            return self.spark.createDataFrame([], T.StructType([*self.ROWS.fields, T.StructField("event_date", T.DateType())]))
        return self._table().where(F.col("valid") == valid).join(self.committed().select("batch_id"), "batch_id", "left_semi") \
            .drop("batch_id", "valid")

    def events(self) -> DataFrame:
        """Valid events, with their date."""
        return self._read(True).drop("value", "reason", "rejected_at")

    def rejects(self) -> DataFrame:
        """value, reason, rejected_at of the events turned away."""
        return self._read(False).select("value", "reason", "rejected_at")

    def files(self) -> str:
        """The valid events' folders, for a stream over a finished ingest."""
        return f"{self.data}/batch_id=*/valid=true"


def atomic_ingest(raw: DataFrame, sink: AtomicSink, checkpoint: str) -> None:
    """Everything there is (availableNow) through one query and one sink."""
    sink.open()
    q = (raw.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def publish_events(events: DataFrame, path: str) -> None:
    """Rating events (user_id, movie_id, rating, ts) as files of JSON lines,
    the batch counterpart of producers sending one message each (S8)."""
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events.select(event_json(F.col("user_id"), F.col("movie_id"), F.col("rating"), when).alias("value")) \
        .write.mode("append").text(path)


def event_json(user_id: Column, movie_id: Column, rating: Column, when: Column) -> Column:
    """A rating event as JSON text."""
    return F.to_json(F.named_struct(F.lit("user_id"), user_id, F.lit("movieId"), movie_id,
                                    F.lit("rating"), rating, F.lit("timestamp"), when))


def event_text() -> Column:
    """A rating event of the columns event_id, user_id, movie_id, rating, ts and
    event_type as a line: malformed for those of type ``error``."""
    return F.when(F.col("event_type") == "error", F.concat(F.lit("not json: "), F.col("event_id").cast("string"))).otherwise(
        F.to_json(F.struct("event_id", "user_id", F.col("movie_id").alias("movieId"), "rating",
                           F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"))))
