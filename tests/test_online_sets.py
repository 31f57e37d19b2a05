"""Online seen sets against sets of the finished table."""

import random

import pytest
from pyspark.sql import functions as F

from cinestat.streaming import online_sets, seen
from cinestat.streaming.ingest import INGESTED

DAY = 86_400


def brute(events, gap=DAY):
    """{(user, start, end, events, item)}: neighbours more than a gap apart split."""
    out = set()
    for user in {u for u, _, _ in events}:
        mine, group = sorted((t, m) for u, m, t in events if u == user), []
        for t, m in mine + [(None, None)]:
            if group and (t is None or t - group[-1][0] > gap):
                out |= {(user, group[0][0], group[-1][0] + gap, len(group), x) for _, x in group}
                group = []
            group.append((t, m))
    return out


def test_sets_do_not_depend_on_the_order_of_events():
    rng = random.Random(1)
    for _ in range(300):
        times = [rng.randint(0, 60) for _ in range(rng.randint(1, 14))]
        sets, at = [], {}
        order = times[:]
        rng.shuffle(order)
        while order:
            batch, order = sorted(order[:3]), order[3:]
            sets, moved, went = online_sets.joined(sets, batch, 5)
            for old, new in moved:
                at = {k: new if n == old else n for k, n in at.items()}
            for t, n in zip(batch, went):
                at[t] = n
        want = brute([(0, t, t) for t in times], 5)
        assert {(s[1], s[2] + 5, s[3]) for s in sets} == {w[1:4] for w in want}
        groups = {}
        for t, n in at.items():
            groups.setdefault(n, set()).add(t)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (
            {w[4] for w in want if w[1:3] == key} for key in {w[1:3] for w in want})))


def write(spark, path, events):
    rows = [(i, u, m, 1.0, None if t is None else f"1970-01-{1 + t // DAY:02d}T{t % DAY // 3600:02d}:{t % 3600 // 60:02d}:{t % 60:02d}")
            for i, (u, m, t) in enumerate(events)]
    spark.createDataFrame(rows, INGESTED).coalesce(1).write.mode("append").parquet(path)


def found(spark, path):
    return {tuple(r) for r in spark.read.parquet(path).select(
        "user_id", F.unix_timestamp("session_start"), F.unix_timestamp("session_end"), "n_events", "movie_id").collect()}


@pytest.mark.parametrize("batches", [1, 4])
def test_stream_equals_the_finished_table(spark, tmp_path, batches):
    """Many batches over several runs, each run restarting from the checkpoint."""
    rng = random.Random(batches)
    events = sorted(((rng.randint(1, 4), rng.randint(1, 9), rng.randint(0, 20 * DAY)) for _ in range(160)), key=lambda e: e[2])
    src, out, check = (f"{tmp_path}/{x}" for x in ("src", "out", "check"))
    step = -(-len(events) // batches)
    for a in range(0, len(events), step):
        part = events[a:a + step]
        rng.shuffle(part)
        write(spark, src, part)
        seen.run_to_table(online_sets.seen_items_stream(seen.ingested_stream(spark, src), DAY), out, check)
    early = found(spark, out)
    seen.write_end_marker(spark, src)
    seen.run_to_table(online_sets.seen_items_stream(seen.ingested_stream(spark, src), DAY), out, check)
    got = spark.read.parquet(out).count()
    assert found(spark, out) == brute(events) and got == len(brute(events))
    if batches > 1:
        assert early and early < brute(events)


def test_late_events_and_events_without_time(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("src", "out", "check"))
    write(spark, src, [(1, 5, 10 * DAY), (2, 6, 10 * DAY), (1, 7, None), (2, None, 10 * DAY + 5)])
    seen.run_to_table(online_sets.seen_items_stream(seen.ingested_stream(spark, src), DAY), out, check)
    # behind the watermark (day 9): dropped. Inside it: joins the set
    write(spark, src, [(1, 8, 2 * DAY), (2, 9, 9 * DAY + 3600)])
    seen.run_to_table(online_sets.seen_items_stream(seen.ingested_stream(spark, src), DAY), out, check)
    seen.write_end_marker(spark, src)
    seen.run_to_table(online_sets.seen_items_stream(seen.ingested_stream(spark, src), DAY), out, check)
    assert found(spark, out) == {(1, 10 * DAY, 11 * DAY, 1, 5), (2, 9 * DAY + 3600, 11 * DAY + 5, 3, 6), (2, 9 * DAY + 3600, 11 * DAY + 5, 3, 9)}


def test_a_session_with_the_default_state_store(spark, tmp_path):
    """The stream brings the store it needs and leaves the session's setting alone."""
    key = "spark.sql.streaming.stateStore.providerClass"
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    ours = spark.conf.get(key)
    src, out, check = (f"{tmp_path}/{x}" for x in ("src", "out", "check"))
    write(spark, src, [(1, 5, 10 * DAY), (1, 6, 10 * DAY + 60)])
    spark.conf.set(key, plain)
    try:
        seen.replay(spark, lambda e: online_sets.seen_items_stream(e, DAY), lambda: seen.ingested_stream(spark, src),
                    f"{tmp_path}/control", out, check, online_sets.STATE_CONF)
        assert spark.conf.get(key) == plain
    finally:
        spark.conf.set(key, ours)
    assert found(spark, out) == {(1, 10 * DAY, 11 * DAY + 60, 2, 5), (1, 10 * DAY, 11 * DAY + 60, 2, 6)}
