"""Statistics kept up batch by batch.

Count, mean and squared deviations of every key are stored in buckets of the
key's hash. A batch is reduced to one row a key first; only the buckets that its
keys fall into are read, combined and written again, as a new version. Then the
list of current versions gets the batch's rows: what it names is the table, so a
failed batch leaves nothing to see, and a repeated one does nothing.

Deviations are combined around the joint mean, so many batches lose no digits to
cancellation, and give what one run over all rows gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_VERSIONS = "batch_id long, bucket int"


class StatsStore:
    def __init__(self, spark: SparkSession, path: str, key: str, value: str, buckets: int = BUCKETS):
        self.spark, self.key, self.value, self.buckets = spark, key, value, buckets
        self.data, self.list = f"{path}/data", f"{path}/versions"
        spark.createDataFrame([], _VERSIONS).write.mode("ignore").parquet(self.list)

    def _versions(self) -> DataFrame:
        return self.spark.read.schema(_VERSIONS).parquet(self.list)

    def current(self) -> dict[int, int]:
        """Bucket to the batch that wrote it last: at most ``buckets`` rows."""
        rows = self._versions().where("bucket >= 0").groupBy("bucket").agg(F.max("batch_id").alias("b")).collect()
        return {r["bucket"]: r["b"] for r in rows}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, versions: dict[int, int]) -> DataFrame:
        """The stored rows of these buckets; the filter is on folders."""
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in versions.items():
            by_batch.setdefault(batch, []).append(bucket)
        wanted = F.lit(False)
        for batch, buckets in sorted(by_batch.items()):
            wanted = wanted | ((F.col("batch_id") == batch) & F.col("bucket").isin(sorted(buckets)))
        return self.spark.read.parquet(self.data).where(wanted).select(self.key, "n", "mean", "m2", F.col("bucket").cast("int").alias("bucket"))

    def reduced(self, rows: DataFrame) -> DataFrame:
        """A batch as one row a key."""
        v = F.col(self.value).cast("double")
        n = F.count(F.lit(1))
        return (rows.where(v.isNotNull() & F.col(self.key).isNotNull()).groupBy(self.key)
                .agg(n.alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * n).alias("m2")).withColumn("bucket", self._bucket()))

    def combined(self, delta: DataFrame, touched: dict[int, int]) -> DataFrame:
        """``delta`` with the stored rows of the buckets it touches."""
        if not touched:
            return delta
        old = self._read(touched).select(self.key, *(F.col(c).alias(f"o_{c}") for c in ("n", "mean", "m2", "bucket")))
        zero = lambda c: F.coalesce(c, F.lit(0))
        a, b = zero("o_n"), zero("n")
        away = F.col("mean") - F.col("o_mean")
        both = F.col("n").isNotNull() & F.col("o_n").isNotNull()
        return delta.join(old, self.key, "full").select(
            self.key, (a + b).alias("_n"),
            F.when(both, (F.col("o_mean") * a + F.col("mean") * b) / (a + b)).otherwise(F.coalesce("mean", "o_mean")).alias("_mean"),
            F.when(both, F.col("o_m2") + F.col("m2") + away * away * a * b / (a + b)).otherwise(F.coalesce("m2", "o_m2")).alias("_m2"),
            F.coalesce("bucket", "o_bucket").alias("bucket")).select(
            self.key, F.col("_n").alias("n"), F.col("_mean").alias("mean"), F.col("_m2").alias("m2"), "bucket")

    def apply(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch; batches are numbered upwards from 0."""
        if not self._versions().where(F.col("batch_id") == batch_id).isEmpty():
            return
        folder = f"{self.data}/batch_id={batch_id}"
        delta = self.reduced(rows).persist()
        try:
            hit = [r["bucket"] for r in delta.select("bucket").distinct().collect()]  # at most `buckets`
            now = self.current()
            merged = self.combined(delta, {b: now[b] for b in hit if b in now})
            merged.repartition(len(hit) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        finally:
            delta.unpersist()
        self.commit(batch_id, hit)

    def commit(self, batch_id: int, hit: list[int]) -> None:
        # a batch without rows is noted too, under no bucket
        self.spark.createDataFrame([(batch_id, b) for b in hit or [-1]], _VERSIONS).coalesce(1).write.mode("append").parquet(self.list)

    def stats(self) -> DataFrame:
        """key, count, mean, sample deviation (NULL for one row)."""
        now = self.current()
        if not now:
            return self.spark.createDataFrame([], f"{self.key} long, rating_count long, rating_mean double, rating_std double")
        return self._read(now).select(self.key, F.col("n").alias("rating_count"), F.col("mean").alias("rating_mean"),
                                      F.sqrt(F.try_divide(F.greatest("m2", F.lit(0.0)), F.col("n") - 1)).alias("rating_std"))
