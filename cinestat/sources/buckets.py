"""Bucketed tables: stored in the layout their joins need.

A table that is joined or grouped by one key again and again is written once,
dealt out by that key into a fixed number of files, each sorted by it. Two such
tables of the same number of buckets join without a shuffle, and an aggregate by
the key needs none either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat.session import scratch_path

BUCKETS = 64


def bucketed(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> str:
    """``df`` stored below the shared folder, bucketed and sorted by ``key``;
    returns the name it has in the session's catalogue."""
    spark = df.sparkSession
    path = scratch_path(spark, f"bucketed-{name}")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # one file a bucket: the rows are dealt out as the buckets are
    (df.repartition(buckets, F.col(key)).write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return table
