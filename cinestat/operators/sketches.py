"""Stored sketches: group quantiles by KLL, distinct counts by theta.

A sketch is a column of bytes per group. Sketches of parts (a year, a day, a file)
are written once and merged later for any coarser group, so a report over all
years reads sketches, not rows, and a new part adds its own. Both kinds are
built with a partial phase in every task, so no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KLL_K = 2048
# The published single-sided rank error of a KLL sketch is 2.296 / k^0.9723 (99 %); three times that leaves no doubt.
RANK_ERROR = 3 * 2.296 / KLL_K ** 0.9723
THETA_LG = 14  # 2^14 hashes: exact up to there, then a relative error of 1 / sqrt(2^14) (one standard deviation)
THETA_ERROR = 4 / 2 ** (THETA_LG / 2)


def quantile_parts(df: DataFrame, keys: list[str], value: str, k: int = KLL_K) -> DataFrame:
    """keys, n, sketch: a KLL sketch of the non-null values of every group."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch")))


def merged_quantiles(parts: DataFrame, keys: list[str], ranks: dict[str, float], k: int = KLL_K) -> DataFrame:
    """keys, n and a column a rank, from the sketches of finer groups."""
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return whole.select(*keys, "n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in ranks.items()))


def rank_within(df: DataFrame, keys: list[str], value: str, answers: DataFrame, answer: str, rank: float,
                error: float = RANK_ERROR) -> DataFrame:
    """keys, n, within: whether the answer's true rank among the group's values
    lies at most ``error`` from ``rank``. One pass over the values."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).join(answers.select(*keys, answer), keys)
    n = F.count(F.lit(1))
    below, upto = F.count_if(F.col(value) < F.col(answer)), F.count_if(F.col(value) <= F.col(answer))
    return rows.groupBy(*keys).agg(n.alias("n"), ((below <= (rank + error) * n) & (upto >= (rank - error) * n)).alias("within"))


def distinct_parts(df: DataFrame, keys: list[str], value: str, lg: int = THETA_LG) -> DataFrame:
    """keys, sketch: a theta sketch of the distinct non-null values of every group."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.theta_sketch_agg(value, lg).alias("sketch"))


def union(sketch: str, lg: int = THETA_LG) -> Column:
    """The sketch of all values in any sketch (an aggregate)."""
    return F.theta_union_agg(sketch, lg)


def coverage(left: DataFrame, right: DataFrame, lg: int = THETA_LG) -> DataFrame:
    """n_left, n_right, n_both: distinct values of two sets of parts, and of
    both, from sketches alone."""
    both = left.select(F.lit(0).alias("side"), "sketch").unionByName(right.select(F.lit(1).alias("side"), "sketch"))
    sides = both.groupBy("side").agg(union("sketch", lg).alias("s"))
    pair = sides.agg(F.max(F.when(F.col("side") == 0, F.col("s"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("s"))).alias("r"))
    size = lambda s: F.coalesce(F.theta_sketch_estimate(s), F.lit(0).cast("long"))
    return pair.select(size(F.col("l")).alias("n_left"), size(F.col("r")).alias("n_right"),
                       size(F.theta_intersection("l", "r")).alias("n_both"))
