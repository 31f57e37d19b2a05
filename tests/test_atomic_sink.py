"""The ingest sink under failures and repeated batches."""

import pytest

from cinestat.streaming import ingest

LINES = ['{"event_id": 1, "user_id": 5, "movieId": 7, "rating": 3.0, "timestamp": "2024-05-01T10:00:00"}',
         '{"event_id": 2, "userId": 6, "movieId": 8, "rating": 4.0, "date": "2024-05-02"}',
         '{"event_id": 3, "userId": 6, "movieId": 9}', "not json: 4", '{"event_id": 5, "movieId": 8}', '{"event_id": 6, "userId": 8}',
         '{"event_id": 7, "userId": 8, "movieId": 1, "timestamp": "soon"}', "", "[]"]
REASONS = ["bad_time", "no_movie", "no_user", "not_json", "not_json", "not_json"]


def put(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def state(sink):
    return (sorted(r["event_id"] for r in sink.events().collect()), sorted(r["reason"] for r in sink.rejects().collect()))


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    src, check = f"{tmp_path}/src", f"{tmp_path}/check"
    sink = ingest.AtomicSink(spark, f"{tmp_path}/sink")
    put(spark, src, LINES)
    real = ingest.AtomicSink.commit

    def killed(self, batch_id):
        raise RuntimeError("killed between the rows and the commit")

    monkeypatch.setattr(ingest.AtomicSink, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        ingest.atomic_ingest(ingest.file_source(spark, src), sink, check)
    assert state(sink) == ([], [])  # rows are there, but not committed
    monkeypatch.setattr(ingest.AtomicSink, "commit", real)
    ingest.atomic_ingest(ingest.file_source(spark, src), sink, check)
    assert state(sink) == ([1, 2, 3], REASONS)
    # killed after the commit, before the stream noted it: the batch comes again
    sink.write(spark.createDataFrame([(x,) for x in LINES], "value string"), 0)
    assert state(sink) == ([1, 2, 3], REASONS)
    put(spark, src, LINES[:2])
    ingest.atomic_ingest(ingest.file_source(spark, src), sink, check)
    assert state(sink) == ([1, 1, 2, 2, 3], REASONS)
    assert sorted((r["batch_id"], r["n_rows"]) for r in sink.committed().collect()) == [(0, 9), (1, 2)]
    rejects = sink.rejects().collect()
    assert all(r["rejected_at"] is not None for r in rejects) and {"soon" in (r["value"] or "") for r in rejects} == {True, False}
    assert {str(r["event_date"]) for r in sink.events().collect()} == {"2024-05-01", "2024-05-02", "None"}


def test_the_source_is_read_once(spark, tmp_path):
    src = f"{tmp_path}/src"
    put(spark, src, LINES)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    raw = ingest.file_source(spark, src).mapInArrow(counted, "value string")
    ingest.atomic_ingest(raw, ingest.AtomicSink(spark, f"{tmp_path}/sink"), f"{tmp_path}/check")
    assert reads.value == len(LINES)
