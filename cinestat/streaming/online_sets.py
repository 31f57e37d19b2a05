"""Online seen sets with one state entry an item.

The state of a user: a map (set number, item) -> nothing, and one value with the
open sets (number, first event, last event, events). An event writes its own map
entry and the value; the items of a set are read only when the set closes, so a
long set costs an event nothing. Every event moves the end of its set to its own
time plus the gap (the expiry that each event refreshes), by an event-time timer.

A set closes when the watermark has passed its end, and only then: until then an
older event may still come, extend it backwards, or join two sets into one. So
the sets do not depend on how the events fall into batches. At most a few sets of
a user are open at once, those whose end the watermark has not passed. Events
behind the watermark are dropped.

A map and timers are several column families of one state store, which the
engine's default store does not have: the stream runs under ``STATE_CONF``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cinestat.session import BASE_CONF

STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": BASE_CONF["spark.sql.streaming.stateStore.providerClass"]}
SET_ITEMS = "user_id long, session_start timestamp, session_end timestamp, n_events long, movie_id long"
_COLUMNS = ["user_id", "session_start", "session_end", "n_events", "movie_id"]


def joined(open_sets: list[list[int]], us: list[int], gap: int) -> tuple[list[list[int]], list[tuple[int, int]], list[int]]:
    """Open sets after events at the times ``us`` (ascending): the sets (number,
    first, last, events), the merged ones (old number, new number), and the
    number of the set each event went to.

    Neighbours in time order belong together when they are at most ``gap`` apart."""
    after, moved, went = [list(s) for s in open_sets], [], []
    free = max((s[0] for s in after), default=-1) + 1
    for t in us:
        near = [s for s in after if s[1] - gap <= t <= s[2] + gap]
        if not near:
            near = [[free, t, t, 0]]
            after.append(near[0])
            free += 1
        into = near[0]
        for other in near[1:]:
            moved.append((other[0], into[0]))
            into[1], into[2], into[3] = min(into[1], other[1]), max(into[2], other[2]), into[3] + other[3]
            after.remove(other)
            went = [into[0] if w == other[0] else w for w in went]
        into[1], into[2], into[3] = min(into[1], t), max(into[2], t), into[3] + 1
        went.append(into[0])
    return after, moved, went


class SeenSets(StatefulProcessor):
    """One row an item of every closed set."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "set_no long, movie_id long", "seen boolean")
        self.open = handle.getValueState("open", "sets array<array<long>>")

    def _open(self) -> list[list[int]]:
        return [list(s) for s in self.open.get()[0]] if self.open.exists() else []

    def _end(self, last: int) -> int:
        """The first millisecond at which no event can still reach the set."""
        return (last + self.gap) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = []
        for pdf in rows:
            if key[0] is None or pd.isna(key[0]):
                continue  # the end-of-stream marker: it has moved the watermark
            pdf = pdf[pdf["ts"].notna()]  # an event without a time belongs to no set
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            events += zip(us.tolist(), [None if pd.isna(m) else int(m) for m in pdf["movie_id"]], strict=True)
        if events:
            self._add(sorted(events, key=lambda e: e[0]))
        yield pd.DataFrame(columns=_COLUMNS)

    def _add(self, events: list[tuple[int, int | None]]) -> None:
        before = self._open()
        after, moved, went = joined(before, [t for t, _ in events], self.gap)
        known = {s[0] for s in before}
        for old, new in moved:
            if old in known:
                for no, item in [k for k in self.items.keys() if k[0] == old]:
                    self.items.updateValue((new, item), (True,))
                    self.items.removeKey((no, item))
        for no, item in {(n, m) for n, (_, m) in zip(went, events, strict=True) if m is not None}:
            self.items.updateValue((no, item), (True,))
        self.open.update((after,))
        ends, was = {self._end(s[2]) for s in after}, {self._end(s[2]) for s in before}
        for t in was - ends:
            self.handle.deleteTimer(t)
        for t in ends - was:
            self.handle.registerTimer(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        sets = self._open()
        closed = {s[0]: s for s in sets if self._end(s[2]) <= now}
        left = [s for s in sets if s[0] not in closed]
        out = []
        if closed:
            for no, item in [k for k in self.items.keys() if k[0] in closed]:
                _, first, last, n = closed[no]
                out.append((int(key[0]), pd.Timestamp(first, unit="us"), pd.Timestamp(last + self.gap, unit="us"), n, item))
                self.items.removeKey((no, item))
            if left:
                self.open.update((left,))
            else:
                self.open.clear()
        yield pd.DataFrame(out, columns=_COLUMNS)


def seen_items_stream(events: DataFrame, gap_seconds: int = 86400, watermark: str = "1 day") -> DataFrame:
    """user_id, session_start, session_end, n_events, movie_id: the items of every
    set the watermark has passed. ``events``: user_id, movie_id, ts. Start it with
    the settings ``STATE_CONF``."""
    return (events.select("user_id", "movie_id", "ts").withWatermark("ts", watermark).groupBy("user_id")
            .transformWithStateInPandas(SeenSets(gap_seconds), outputStructType=SET_ITEMS, outputMode="Append", timeMode="EventTime"))
