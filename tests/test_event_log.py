"""The event log's offsets: start, restart, failed appends."""

import pytest
from pyspark.sql import functions as F

from cinestat.streaming import event_log


def put(spark, path, first, last, parts=3):
    df = spark.range(first, last).select(F.col("id").cast("string").alias("value"), "id")
    event_log.append_events(df, path, F.col("id"), ["id"], parts)


def run(spark, path, out, check, starting="latest", during=None):
    sizes = []

    def write(batch, _):
        batch.persist()
        sizes.append(batch.count())
        batch.write.mode("append").parquet(out)
        batch.unpersist()

    q = event_log.log_source(spark, path, starting).writeStream.foreachBatch(write).option("checkpointLocation", check).start()
    try:
        q.processAllAvailable()
        if during:
            during()
            q.processAllAvailable()
    finally:
        q.stop()
    return [n for n in sizes if n]


def got(spark, out):
    return sorted(int(r["value"]) for r in spark.read.schema(event_log.SCHEMA).parquet(out).collect())


def test_latest_skips_the_past_and_a_restart_resumes(spark, tmp_path):
    path, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    put(spark, path, 0, 50)
    run(spark, path, out, check, during=lambda: put(spark, path, 50, 80))
    assert got(spark, out) == list(range(50, 80))
    put(spark, path, 80, 95)  # while nothing runs
    run(spark, path, out, check, during=lambda: put(spark, path, 95, 99))
    assert got(spark, out) == list(range(50, 99))


def test_earliest_reads_all_once_in_order(spark, tmp_path):
    path, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    put(spark, path, 0, 40)
    put(spark, path, 40, 70)
    sizes = run(spark, path, out, check, "earliest")
    assert got(spark, out) == list(range(70)) and sum(sizes) == 70
    rows = spark.read.parquet(out).collect()
    for p in range(3):
        mine = sorted((r["offset"], int(r["value"])) for r in rows if r["partition"] == p)
        assert [o for o, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_an_append_without_its_list_does_not_exist(spark, tmp_path):
    path, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    put(spark, path, 0, 20)
    spark.range(5).select(F.lit(0).alias("partition"), F.col("id").alias("offset"), F.lit("lost").alias("value")) \
        .write.parquet(f"{path}/segments/failed")
    run(spark, path, out, check, "earliest")
    assert got(spark, out) == list(range(20))
    with pytest.raises(ValueError):
        event_log.LogReader({"path": path, "startingOffsets": "somewhere"})
