"""Seen sets and the latest event as streaming queries.

``session_window`` with a watermark gives, in append mode, each closed
seen-set lifetime once its gap has passed the watermark; the batch form in
``cinestat.operators.sessions`` gives the same sessions for a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinestat.streaming.ingest import INGESTED, AtomicSink, event_time


def committed_stream(sink: AtomicSink) -> DataFrame:
    """The valid events of a finished ingest as a stream with event time. The
    folders' columns are part of the schema, or the file source would miss them."""
    folders = T.StructType([*INGESTED.fields, T.StructField("batch_id", T.LongType()), T.StructField("valid", T.BooleanType()),
                            T.StructField("event_date", T.DateType())])
    return (sink.spark.readStream.schema(folders).option("basePath", sink.data).parquet(sink.files()).select(*INGESTED.names)
            .withColumn("ts", event_time(F.col("ts_text"))))


def ingested_stream(spark, sink: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The ingest sink read back as a stream with event time. With a bound on
    the files of a batch, files must come in time order, or the watermark must
    be as wide as their disorder: what lies behind it is late and left out."""
    reader = spark.readStream.schema(INGESTED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (reader.parquet(sink)
            .withColumn("ts", event_time(F.col("ts_text"))))


END_OF_STREAM = "2200-01-01"


def open_control(spark, path: str) -> None:
    """An empty control folder, so that a stream over it can start."""
    spark.createDataFrame([], INGESTED).write.mode("overwrite").parquet(path)


def write_end_marker(spark, path: str, when: str = END_OF_STREAM) -> None:
    """Add an end-of-stream marker (no user, far-future time) to a control
    folder. Streamed next to the events once these have been drained, it moves
    the watermark past every real session, so a replay of a finished event log
    closes and emits all of them; the marker itself is never emitted."""
    spark.createDataFrame([(None, None, None, None, when)], INGESTED).write.mode("append").parquet(path)


def replay(spark, closed_sets, events, control: str, out: str, checkpoint: str, conf: dict[str, str] | None = None) -> None:
    """Drain ``events()`` into ``out`` in as many batches as it takes, and only
    then let the marker through: a marker in an early batch would make every
    later event late. ``closed_sets`` maps a stream to its closed sets; ``conf``
    as in ``run_to_table``."""
    open_control(spark, control)
    for last in (False, True):
        if last:
            write_end_marker(spark, control)
        both = events().unionByName(ingested_stream(spark, control))
        run_to_table(closed_sets(both), out, checkpoint, conf=conf)


def seen_session_stream(events: DataFrame, gap: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """user_id, session_start, session_end, n_events, n_items per closed session."""
    # A row without a user (an end-of-stream marker) only advances the
    # watermark: its own session ends after the watermark it sets, so it is
    # never emitted. (A filter on user_id would be pushed below the
    # watermark and take the marker's event time with it.)
    return (events.withWatermark("ts", watermark)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.collect_set("movie_id").alias("_items"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events", F.size("_items").alias("n_items"),
                    F.aggregate("_items", F.lit(0).cast("long"), lambda a, x: a + x).alias("items_sum")))


def latest_event_stream(events: DataFrame) -> DataFrame:
    """Complete-mode register of the latest event (T4)."""
    return events.agg(F.max_by(F.struct("event_id", "user_id", "movie_id", "rating", "ts"),
                               F.struct("ts", "event_id")).alias("latest")).select("latest.*")


@contextmanager
def held(spark, conf: dict[str, str]) -> Iterator[None]:
    """The session with the settings ``conf``, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Run a streaming query over all available input into Parquet (append)
    or into memory-free complete output via foreachBatch overwrite. ``conf``:
    settings the stream needs whatever the session has; a stream keeps those it
    was started with."""
    with held(df.sparkSession, conf or {}):
        if mode == "append":
            q = (df.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        else:
            def write(batch, _epoch):
                batch.write.mode("overwrite").parquet(path)
            q = (df.writeStream.outputMode("complete").foreachBatch(write)
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


SEEN_STATE = "start_us long, last_us long, n_events long, items array<long>"
SEEN_OUT = ("user_id long, session_start timestamp, session_end timestamp, n_events long, n_items long, "
            "items_sum long")


def seen_set_state_stream(events: DataFrame, gap_seconds: int = 86400, watermark: str = "1 day") -> DataFrame:
    """Online seen sets with per-user state (T3, D14): the Redis set with a
    TTL that every event refreshes, in event time.

    State per user: set start, last event time, event count and the item
    set (bounded by the catalogue, as the Redis set is). An event more than
    ``gap`` after the last one closes the set and starts a new one; the state
    times out -- and the set is emitted as closed -- once the watermark passes
    last event + gap. Output rows are closed sets only (append semantics),
    the same rows the batch form gives for sessions that have ended.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap_us = gap_seconds * 1_000_000

    def closed(user, start, last, n, items):
        return {"user_id": user, "session_start": pd.Timestamp(start, unit="us"),
                "session_end": pd.Timestamp(last + gap_us, unit="us"), "n_events": n,
                "n_items": len(items), "items_sum": int(sum(items))}

    def summarize(batches) -> dict:
        """gap-wide time bucket -> [first, last, count, items], folded one
        Arrow chunk at a time: memory grows with the buckets and distinct
        items of this micro-batch, not with the user's event count."""
        buckets: dict = {}
        for pdf in batches:
            pdf = pdf[pdf["ts"].notna()]  # an event without a time belongs to no set
            if pdf.empty:
                continue
            us = pd.to_datetime(pdf["ts"]).astype("datetime64[us]").astype("int64")
            df = pd.DataFrame({"b": us // gap_us, "t": us, "i": pdf["movie_id"].astype("int64")})
            g = df.groupby("b")["t"].agg(["min", "max", "size"])
            items = df.drop_duplicates(["b", "i"]).groupby("b")["i"].agg(list)
            for b, (lo, hi, c) in zip(g.index.tolist(), g.itertuples(index=False)):
                cur = buckets.setdefault(b, [lo, hi, 0, set()])
                cur[0], cur[1], cur[2] = min(cur[0], lo), max(cur[1], hi), cur[2] + int(c)
                cur[3].update(items[b])
        return buckets

    def step(key, batches, state):
        out = []
        if key[0] is None or pd.isna(key[0]):
            # end-of-stream marker: it has moved the watermark; no state
            for _ in batches:
                pass
        elif state.hasTimedOut:
            user = int(key[0])
            start, last, n, items = state.get
            out.append(closed(user, start, last, n, list(items)))
            state.remove()
        else:
            user = int(key[0])
            if state.exists:
                start, last, n, items = state.get
                items = set(items)
            else:
                start = last = None
                n, items = 0, set()
            # inside a bucket no two events are more than gap apart, so a set
            # can only close between consecutive non-empty buckets
            for _, (first, end, c, its) in sorted(summarize(batches).items()):
                if last is not None and first - last > gap_us:
                    out.append(closed(user, start, last, n, items))
                    start, n, items = None, 0, set()
                start = first if start is None else min(start, first)
                last = end if last is None else max(last, end)
                n += c
                items |= its
            if last is not None:
                state.update((start, last, n, sorted(items)))
                # a set that the watermark has passed already closes at the next chance
                state.setTimeoutTimestamp(max((last + gap_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "session_start", "session_end", "n_events", "n_items",
                                         "items_sum"])

    return (events.select("user_id", "movie_id", "ts").withWatermark("ts", watermark)
            .groupBy("user_id")
            .applyInPandasWithState(step, SEEN_OUT, SEEN_STATE, "append", GroupStateTimeout.EventTimeTimeout))
