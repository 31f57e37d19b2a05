"""Per-user "seen" sets that expire after a quiet gap, and the latest-event
register (T3, T4, A18, A19, D14).

A user's set lives until ``gap`` passes without an event of that user; each
event refreshes the lifetime of the whole set. In event time that is a
session: a new session starts when the gap to the user's previous event is
longer than ``gap``.

Batch form without sending a user's whole history to one task: events are
bucketed into windows of width ``gap`` per user. Inside one bucket no two
events are more than ``gap`` apart, so session breaks can only fall between
consecutive non-empty buckets and follow from each bucket's min and max
time. The ordered pass then runs over buckets (bounded by the time span, not
by the user's event count), and the events join back to their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Returns (sessions, bucket_map).

    sessions: key, session_no, start_us, last_us -- one row per session.
    bucket_map: key, _bucket, session_no -- to attach events to sessions.
    """
    gap = gap_seconds * 1_000_000
    ev = events.select(key, _micros(ts).alias("_us")).filter(F.col("_us").isNotNull())
    buckets = (ev.groupBy(key, F.floor(F.col("_us") / gap).alias("_bucket"))
               .agg(F.min("_us").alias("_first"), F.max("_us").alias("_last")))
    w = Window.partitionBy(key).orderBy("_bucket")
    prev_last = F.lag("_last").over(w)
    new = F.when(prev_last.isNull() | ((F.col("_first") - prev_last) > gap), 1).otherwise(0)
    numbered = (buckets.withColumn("_new", new)
                .withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    sessions = (numbered.groupBy(key, "session_no")
                .agg(F.min("_first").alias("start_us"), F.max("_last").alias("last_us")))
    return sessions, numbered.select(key, "_bucket", "session_no")


def seen_sessions(events: DataFrame, user: str = "user_id", item: str = "movie_id", ts: str = "ts",
                  gap_seconds: int = 86400) -> DataFrame:
    """user, session_start, session_end (= last event + gap, when the set
    expires), n_events, n_items, items_sum -- one row per seen-set lifetime."""
    gap = gap_seconds * 1_000_000
    sessions, bmap = sessionize(events, user, ts, gap_seconds)
    ev = events.select(user, item, _micros(ts).alias("_us")).filter(F.col("_us").isNotNull())
    ev = ev.withColumn("_bucket", F.floor(F.col("_us") / gap)).join(bmap, [user, "_bucket"])
    # distinct items per session in two steps: (session, item) spreads a hot
    # session over many reducers, the second step only counts
    per_item = ev.groupBy(user, "session_no", item).agg(F.count(F.lit(1)).alias("_c"))
    per_session = per_item.groupBy(user, "session_no").agg(
        F.sum("_c").alias("n_events"), F.count(F.lit(1)).alias("n_items"), F.sum(item).alias("items_sum"))
    return (sessions.join(per_session, [user, "session_no"])
            .select(user, F.timestamp_micros("start_us").alias("session_start"),
                    F.timestamp_micros(F.col("last_us") + gap).alias("session_end"),
                    "n_events", "n_items", "items_sum"))


def seen_items(events: DataFrame, user: str = "user_id", item: str = "movie_id", ts: str = "ts",
               gap_seconds: int = 86400) -> DataFrame:
    """The sets themselves in long form: user, session_start, item (distinct)."""
    gap = gap_seconds * 1_000_000
    sessions, bmap = sessionize(events, user, ts, gap_seconds)
    ev = (events.select(user, item, _micros(ts).alias("_us")).filter(F.col("_us").isNotNull())
          .withColumn("_bucket", F.floor(F.col("_us") / gap)).join(bmap, [user, "_bucket"])
          .select(user, "session_no", item).distinct())
    return ev.join(sessions, [user, "session_no"]).select(
        user, F.timestamp_micros("start_us").alias("session_start"), item)


def active_seen(events: DataFrame, as_of, user: str = "user_id", item: str = "movie_id", ts: str = "ts",
                gap_seconds: int = 86400) -> DataFrame:
    """(user, item) pairs whose set is still alive at ``as_of`` -- what the
    serving layer excludes."""
    gap = gap_seconds * 1_000_000
    as_of_us = F.unix_micros(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp"))
    sessions, _ = sessionize(events, user, ts, gap_seconds)
    live = sessions.filter((F.col("last_us") + gap > as_of_us) & (F.col("start_us") <= as_of_us))
    items = seen_items(events, user, item, ts, gap_seconds)
    return (items.join(live.select(user, F.timestamp_micros("start_us").alias("session_start")),
                       [user, "session_start"], "left_semi").select(user, item).distinct())


def latest_event(events: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The single most recent event (T4, A19): ``max_by`` with a tie-break,
    a global aggregate with a map-side phase."""
    cols = events.columns
    best = F.max_by(F.struct(*cols), F.struct(ts, tie)).alias("_b")
    return events.agg(best).select(*[F.col("_b")[c].alias(c) for c in cols])
