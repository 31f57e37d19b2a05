"""Profiling aggregates: table shape, quality counters, parse failures, year
checks, quantile profiles, referential integrity, null report, histograms
(S10, V1-V5, V9, V10, A1-A5, A8, A11, A13-A16).

Each report is one aggregate pass over its input (several metrics fused into
one ``agg``), never one job per metric.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinestat.functions.casts import parse_grouped_int, year_flags
from cinestat.operators.quantile import quantile_row


def _null_or_empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows, n_cols for every table (S10, A1): one count per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """First n rows as a peek (O4); a limit, not a full scan."""
    return df.limit(n)


def quality_counters(movies_raw: DataFrame) -> DataFrame:
    """Row, distinct-id and missing-value counters of raw movies (V1, A2, A3).

    "zero or null" counts NULL explicitly: ``isin`` with a NULL member never
    matches NULL.
    """
    def zero_or_null(c):
        return F.count_if(F.col(c).isNull() | F.col(c).isin("", "0")).alias(f"{c}_zero_or_null")

    return movies_raw.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_distinct_id"),
        F.count_if(_null_or_empty("id")).alias("id_null_or_empty"),
        zero_or_null("budget"), zero_or_null("revenue"), zero_or_null("runtime"),
        F.count_if(_null_or_empty("release_date")).alias("release_date_null_or_empty"),
        F.count_if(_null_or_empty("genres")).alias("genres_null_or_empty"),
    )


def parse_failures(checks: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """column, n, n_null, n_failed per parsed text column (V2, A4).

    ``checks`` maps a name to (table, source text column, parsed column).
    A failure is a non-NULL text whose parse is NULL.
    """
    parts = []
    for name, (df, src, parsed) in checks.items():
        parts.append(df.select(F.col(src).alias("_s"), parsed.alias("_p"))
                     .agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.when(F.col("_s").isNull(), 1).otherwise(0)).alias("n_null"),
                          F.sum(F.when(F.col("_s").isNotNull() & F.col("_p").isNull(), 1).otherwise(0))
                          .alias("n_failed"))
                     .select(F.lit(name).alias("column_name"), "n", "n_null", "n_failed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def year_sanity(movies: DataFrame, earliest: int = 1895, latest: int = 2025) -> DataFrame:
    """n, unparsed dates, years before ``earliest`` / after ``latest``."""
    early, late = year_flags(F.col("release_year"), earliest, latest)
    return movies.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("release_date").isNull(), 1).otherwise(0)).alias("release_date_null"),
        F.sum(F.when(early, 1).otherwise(0)).alias(f"year_before_{earliest}"),
        F.sum(F.when(late, 1).otherwise(0)).alias(f"year_after_{latest}"))


def year_distribution(movies: DataFrame) -> DataFrame:
    """movies per release year, ordered (V3, A5)."""
    return movies.groupBy("release_year").agg(F.count(F.lit(1)).alias("n_movies")).orderBy("release_year")


PROFILE_QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def quantile_profile(movies_raw: DataFrame, cols: Sequence[str] = ("budget", "revenue", "vote_count"),
                     qs: Sequence[float] = PROFILE_QUANTILES) -> DataFrame:
    """Non-null count and exact discrete quantiles of '1,234'-style number
    columns (V4, F2, A11), one row per column."""
    parsed = movies_raw.select(*[parse_grouped_int(c).alias(c) for c in cols])
    counts = parsed.agg(*[F.count(c).alias(c) for c in cols]).selectExpr(
        f"stack({len(cols)}, {', '.join(f"'{c}', `{c}`" for c in cols)}) as (column_name, n_non_null)")
    found = quantile_row(parsed, cols, qs)
    names = [f"q{int(round(q * 100)):03d}" for q in qs]
    return counts.join(F.broadcast(found), "column_name", "left").select(
        "column_name", "n_non_null", *[F.col("q")[i].cast("long").alias(n) for i, n in enumerate(names)])


def link_coverage(movie_ids: DataFrame, link_tmdb_ids: DataFrame, rating_movie_ids: DataFrame,
                  link_movie_ids: DataFrame) -> DataFrame:
    """Referential integrity as rows (V5, J1, J2, A16):
    check, total, matched, unmatched, pct_matched.

    ``movie_ids``/``link_tmdb_ids`` have one column ``k``; the others too.
    The other side's keys are made distinct, so duplicates there do not multiply rows.
    """
    def one(name, left, right):
        # one pass over the left side: a flag from the right side's distinct keys
        flagged = left.select("k").join(right.select("k").distinct().withColumn("_hit", F.lit(1)), "k", "left")
        return (flagged.agg(F.count(F.lit(1)).alias("total"), F.count("_hit").alias("matched"))
                .select(F.lit(name).alias("check_name"), "total", "matched")
                .withColumn("unmatched", F.col("total") - F.col("matched"))
                .withColumn("pct_matched", F.round(F.try_divide(F.col("matched") * 100.0, F.col("total")), 4)))

    return one("movies_with_link", movie_ids, link_tmdb_ids).unionByName(
        one("rating_ids_with_link", rating_movie_ids.distinct(), link_movie_ids))


def orphans(rating_movie_ids: DataFrame, link_movie_ids: DataFrame) -> DataFrame:
    """Distinct rating ids with no link (J2): left anti join."""
    return rating_movie_ids.distinct().join(link_movie_ids, "k", "left_anti")


def orphan_topk(ratings: DataFrame, orphan_ids: DataFrame, k: int = 20) -> DataFrame:
    """Most-rated orphan ids (J3): ratings are counted per id first (map-side
    partial aggregation), then a semi join keeps the orphans (no row
    multiplication), then top-k."""
    return (ratings.groupBy(F.col("movie_id").alias("k")).agg(F.count(F.lit(1)).alias("n_ratings"))
            .join(orphan_ids, "k", "left_semi")
            .orderBy(F.desc("n_ratings"), F.asc("k")).limit(k)
            .select(F.col("k").alias("movie_id"), "n_ratings"))


def null_report(df: DataFrame) -> DataFrame:
    """Percent NULL of every column in one pass."""
    n = F.count(F.lit(1))
    return df.agg(*[F.try_divide(F.count_if(F.col(f"`{c}`").isNull()) * 100.0, n).alias(c) for c in df.columns])


def fixed_histogram(df: DataFrame, col: str, edges: Sequence[float], outside: bool = False) -> DataFrame:
    """bin, lo, hi, n over fixed edges (A14); value v falls in [e_i, e_i+1),
    the last bin is closed. Values outside the edges are not counted, or with
    ``outside`` in two open bins: -1 below (lo NULL), the next number above
    (hi NULL)."""
    v = F.col(col)
    b = F.when(v < edges[0], F.lit(-1)).when(v > edges[-1], F.lit(len(edges) - 1)) if outside else None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = (v >= lo) & ((v < hi) if i < len(edges) - 2 else (v <= hi))
        b = F.when(cond, F.lit(i)) if b is None else b.when(cond, F.lit(i))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    return (df.select(b.alias("bin")).filter(F.col("bin").isNotNull())
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
            .select("bin", F.get(bounds, F.col("bin")).alias("lo"), F.get(bounds, F.col("bin") + 1).alias("hi"), "n"))


def equal_width_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, lo, hi, n over ``bins`` equal-width bins between min and max.

    min / max are scalar subqueries; the maximum falls into the last bin.
    """
    x = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # one scalar subquery (min and max together), carried as a column
    mm = x.agg(F.struct(F.min("_v").alias("mn"), F.max("_v").alias("mx"))).scalar()
    xs = x.withColumn("_mm", mm)
    mn, mx = F.col("_mm.mn"), F.col("_mm.mx")
    width = mx - mn
    raw_bin = F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col("_v") - mn) * bins / width))
    b = F.least(raw_bin, F.lit(bins - 1)).cast("int")
    # min / max ride along as plain doubles (constant per row): fixed-width
    # buffers keep the per-bin count a hash aggregate, with no sort of the rows
    counted = xs.groupBy(b.alias("bin")).agg(F.min(mn).alias("_mn"), F.min(mx).alias("_mx"),
                                             F.count(F.lit(1)).alias("n"))
    w = F.col("_mx") - F.col("_mn")
    return counted.select("bin", (F.col("_mn") + F.col("bin") * w / bins).alias("lo"),
                          (F.col("_mn") + (F.col("bin") + 1) * w / bins).alias("hi"), "n")


SUMMARY_STATS = ("count", "mean", "stddev", "min", "p25", "p50", "p75", "max")


def typed_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df.summary()`` with typed columns and exact quartiles (A13): one row
    per input column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev(x).alias(f"{c}__stddev"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    fields = ["count", "mean", "stddev", "min", "max"]
    stack = "stack({n}, {args}) as (column_name, count, mean, stddev, min, max)".format(
        n=len(cols), args=", ".join(", ".join([f"'{c}'"] + [f"`{c}__{f}`" for f in fields]) for c in cols))
    quartiles = quantile_row(df, cols, [0.25, 0.5, 0.75])
    return df.agg(*aggs).selectExpr(stack).join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name", "count", "mean", "stddev", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def value_histograms(df: DataFrame, bins: dict[str, int]) -> DataFrame:
    """column_name, bin, lo, hi, n for several columns (V10): rows with a
    NULL in any of the columns are dropped first, as the distribution plots do.

    One aggregate finds all ranges, one counts (column, bin) of all columns."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in bins]).dropna()
    ranges = x.agg(F.struct(*[F.struct(F.min(c).alias("mn"), F.max(c).alias("mx")).alias(c) for c in bins])).scalar()
    rows = x.withColumn("_r", ranges).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v"), F.col("_r")[c]["mn"].alias("mn"),
                 F.col("_r")[c]["mx"].alias("mx"), F.lit(n).alias("n_bins")) for c, n in bins.items()])))
    width = F.col("mx") - F.col("mn")
    at = F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col("v") - F.col("mn")) * F.col("n_bins") / width))
    counted = rows.groupBy("column_name", F.least(at, F.col("n_bins") - 1).cast("int").alias("bin")).agg(
        F.min("mn").alias("mn"), F.min("mx").alias("mx"), F.min("n_bins").alias("n_bins"), F.count(F.lit(1)).alias("n"))
    edge = lambda b: F.col("mn") + b * width / F.col("n_bins")
    return counted.select("column_name", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), "n")
