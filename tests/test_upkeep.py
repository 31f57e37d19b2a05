"""Statistics kept up in batches against one run over all rows."""

import random
import statistics

import pytest

from cinestat.operators import upkeep


def plain(rows):
    by = {}
    for k, v in rows:
        if k is not None and v is not None:
            by.setdefault(k, []).append(v)
    return {k: (len(v), statistics.fmean(v), statistics.stdev(v) if len(v) > 1 else None) for k, v in by.items()}


def got(store):
    return {r[0]: (r[1], r[2], r[3]) for r in store.stats().collect()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1]) and (a[k][2] is b[k][2] is None or a[k][2] == pytest.approx(b[k][2], rel=1e-6, abs=1e-6))


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    # values far from zero: sums of squares would lose the deviations
    rows = [(rng.choice([1, 1, 1, rng.randint(2, 300)]), 1e9 + rng.randint(0, 9)) for _ in range(2000)] + [(None, 1.0), (5, None)]
    store = upkeep.StatsStore(spark, str(tmp_path), "movie_id", "rating", 16)
    assert got(store) == {}
    for b in range(4):
        store.apply(spark.createDataFrame(rows[b::4], "movie_id long, rating double"), b)
    store.apply(spark.createDataFrame([], "movie_id long, rating double"), 4)
    store.apply(spark.createDataFrame(rows[1::4], "movie_id long, rating double"), 1)  # repeated: nothing
    same(got(store), plain(rows))


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    store = upkeep.StatsStore(spark, str(tmp_path), "movie_id", "rating", 32)
    store.apply(spark.createDataFrame([(i, float(i % 7)) for i in range(3000)], "movie_id long, rating double"), 0)
    delta = store.reduced(spark.createDataFrame([(17, 3.0), (17, 4.0)], "movie_id long, rating double"))
    hit = delta.first()["bucket"]
    plan = store.combined(delta, {hit: 0})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["bucket"] for r in store._read({hit: 0}).collect()} == {hit}
    store.apply(spark.createDataFrame([(17, 3.0), (17, 4.0)], "movie_id long, rating double"), 1)
    now = store.current()
    assert [b for b, v in now.items() if v == 1] == [hit] and len(now) == 32


def test_a_failed_batch_is_not_seen_and_can_be_repeated(spark, tmp_path, monkeypatch):
    store = upkeep.StatsStore(spark, str(tmp_path), "movie_id", "rating", 4)
    first, more = [(i % 9, float(i)) for i in range(60)], [(i % 11, float(-i)) for i in range(40)]
    store.apply(spark.createDataFrame(first, "movie_id long, rating double"), 0)
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.apply(spark.createDataFrame(more, "movie_id long, rating double"), 1)
    same(got(store), plain(first))
    monkeypatch.undo()
    store.apply(spark.createDataFrame(more, "movie_id long, rating double"), 1)
    same(got(store), plain(first + more))
