"""Grouped reports: a count and named measures per key, with a least count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(rows: DataFrame, key: str, measures: dict[str, Column] | None = None, least: int = 0,
           count_as: str = "n") -> DataFrame:
    """One row per value of ``key``; unsorted, so nothing is range-partitioned
    that the caller does not ask for."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count_as),
                                *(m.alias(name) for name, m in (measures or {}).items()))
    return out.where(F.col(count_as) >= least) if least > 0 else out


def middle(col: str, accuracy: int = 10000) -> Column:
    """Group median as a mergeable sketch: no key pins its values in one buffer."""
    return F.percentile_approx(col, 0.5, accuracy)
