"""Merged sketches against exact ranks and counts."""

import pytest
from pyspark.sql import functions as F

from cinestat.operators import sketches


@pytest.fixture(scope="module")
def values(spark):
    """A group of 300,000 distinct values (a hot one), one of five, one of equal values, one of nulls."""
    hot = spark.range(300_000, numPartitions=7).select(F.lit("hot").alias("g"), (F.col("id") % 9).alias("part"),
                                                       F.pow((F.col("id") * 7919) % 300_007, 2).alias("v"))
    rows = [("few", i, float(i * i)) for i in range(5)] + [("same", i % 3, 4.0) for i in range(50)] + [("none", 1, None), (None, 2, 7.0)]
    return hot.unionByName(spark.createDataFrame(rows, "g string, part long, v double"))


def test_merged_quantiles_keep_the_rank_error(values):
    parts = sketches.quantile_parts(values, ["g", "part"], "v")
    for name, q in (("a", 0.01), ("b", 0.5), ("c", 0.99)):
        merged = sketches.merged_quantiles(parts, ["g"], {name: q})
        got = {r["g"]: (r["n"], r["within"]) for r in sketches.rank_within(values, ["g"], "v", merged, name, q).collect()}
        assert got == {"hot": (300_000, True), "few": (5, True), "same": (50, True)}
        direct = sketches.merged_quantiles(sketches.quantile_parts(values, ["g"], "v"), ["g"], {name: q})
        assert {r["g"] for r in sketches.rank_within(values, ["g"], "v", direct, name, q).where("within").collect()} == set(got)


def test_small_groups_are_exact(values):
    parts = sketches.quantile_parts(values, ["g", "part"], "v")
    got = {r["g"]: (r["lo"], r["mid"], r["hi"]) for r in sketches.merged_quantiles(parts, ["g"], {"lo": 0.0, "mid": 0.5, "hi": 1.0}).collect()}
    assert got["few"] == (0.0, 4.0, 16.0) and got["same"] == (4.0, 4.0, 4.0) and "none" not in got


def test_a_wrong_answer_is_not_within(values):
    wrong = values.select("g").distinct().withColumn("x", F.lit(1e11))
    got = {r["g"]: r["within"] for r in sketches.rank_within(values, ["g"], "v", wrong, "x", 0.5).collect()}
    assert got == {"hot": False, "few": False, "same": False}


@pytest.mark.parametrize("n,shift", [(1000, 400), (200_000, 50_000)])
def test_coverage_from_sketches(spark, n, shift):
    left = sketches.distinct_parts(spark.range(n).select("id", (F.col("id") % 5).alias("p")), ["p"], "id")
    right = sketches.distinct_parts(spark.range(shift, n + shift).select("id", (F.col("id") % 3).alias("p")), ["p"], "id")
    got = sketches.coverage(left, right).first()
    for told, want in zip(got, (n, n, n - shift)):
        assert told == want if n < 2 ** sketches.THETA_LG else abs(told - want) <= sketches.THETA_ERROR * want
    empty = sketches.coverage(left.limit(0), right.limit(0)).first()
    assert tuple(empty) == (0, 0, 0)
