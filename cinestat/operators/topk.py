"""Sorting, top-k and per-group top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k: sort + limit plans as ``TakeOrderedAndProject`` (each
    partition keeps k rows, one task merges k x partitions rows)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str | None = None) -> DataFrame:
    """Rows ranked 1..k within each group by ``order``.

    ``row_number() <= k`` lets Catalyst insert ``WindowGroupLimit`` before the
    shuffle, so each map task forwards at most k rows per group: a hot group
    costs k rows of shuffle, not all of its rows. ``order`` must end in a
    unique column so the result is deterministic.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = rank_col or "_rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def latest_per_key(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                   value_cols: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the row with the greatest ``order_cols`` tuple.

    Uses ``max_by`` -- an aggregate with a partial (map-side) phase -- rather
    than a window, so a key holding a large share of the rows is reduced on
    every map task before the shuffle. ``order_cols`` must be non-NULL.
    """
    value_cols = list(value_cols or [c for c in df.columns if c not in keys])
    best = F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in value_cols])
