"""Cleaning: typed silver tables from raw text (V6, V7), dedup (W1) and
outlier trimming (V8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinestat import schemas as S
from cinestat.functions import pseudo_json
from cinestat.functions.casts import parse_date, text_bool, try_number, zero_to_null
from cinestat.operators.quantile import exact_quantiles
from cinestat.operators.topk import latest_per_key

DATE_FORMAT = "yyyy-MM-dd"


def clean_movies(raw: DataFrame) -> DataFrame:
    """Raw movie text -> typed movies (V6).

    Bad numbers and dates become NULL (``try_cast`` / ``try_to_date``; ANSI
    stays on). Zero budget, revenue and runtime mean "unknown" and become NULL.
    """
    date = parse_date("release_date", DATE_FORMAT)
    return raw.select(
        try_number("id", "int").alias("tmdb_id"),
        F.col("title"),
        date.alias("release_date"),
        F.year(date).alias("release_year"),
        zero_to_null(try_number("budget")).alias("budget"),
        zero_to_null(try_number("revenue")).alias("revenue"),
        zero_to_null(try_number("runtime")).alias("runtime"),
        try_number("vote_average").alias("vote_average"),
        try_number("vote_count", "int").alias("vote_count"),
        try_number("popularity").alias("popularity"),
        text_bool("adult").alias("adult"),
        text_bool("video").alias("video"),
        pseudo_json.parse("genres", S.ID_NAME_LIST).alias("genres_parsed"),
        F.col("production_countries"),
        F.col("spoken_languages"),
    )


def clean_credits(raw: DataFrame) -> DataFrame:
    """credits text -> tmdb_id, cast_parsed, crew_parsed (V7, F9 repair)."""
    return raw.select(try_number("id", "int").alias("tmdb_id"),
                      pseudo_json.parse("cast", S.CAST_LIST).alias("cast_parsed"),
                      pseudo_json.parse("crew", S.CREW_LIST).alias("crew_parsed"))


def clean_keywords(raw: DataFrame) -> DataFrame:
    """keywords text -> tmdb_id, keywords_parsed (V7)."""
    return raw.select(try_number("id", "int").alias("tmdb_id"),
                      pseudo_json.parse("keywords", S.ID_NAME_LIST).alias("keywords_parsed"))


def clean_links(raw: DataFrame) -> DataFrame:
    return raw.select(*[try_number(F.col(c).cast("string"), "int").alias(c) for c in ("movieId", "imdbId", "tmdbId")])


def clean_ratings(raw: DataFrame) -> DataFrame:
    return raw.select(try_number(F.col("userId").cast("string"), "int").alias("userId"),
                      try_number(F.col("movieId").cast("string"), "int").alias("movieId"),
                      try_number(F.col("rating").cast("string"), "double").alias("rating"),
                      try_number(F.col("timestamp").cast("string"), "long").alias("timestamp"))


def dedup_movies(movies: DataFrame, keys=("title", "release_year"), rank_col: str = "vote_count",
                 id_col: str = "tmdb_id") -> DataFrame:
    """Keep one movie per (title, year): most votes first, then lowest id.

    Rows with a NULL title are not duplicates of each other and pass through.
    The pick is a ``max_by`` aggregate (partial aggregation before the
    shuffle), so a (title, year) holding a large share of rows is reduced on
    the map side instead of being sorted in one task.
    """
    cols = movies.columns
    named = movies.filter(F.col(keys[0]).isNotNull())
    order = ["_has_rank", "_rank", "_neg_id"]
    keyed = named.select(*cols,
                         F.col(rank_col).isNotNull().alias("_has_rank"),
                         F.coalesce(F.col(rank_col).cast("long"), F.lit(0)).alias("_rank"),
                         F.coalesce(-F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("_neg_id"))
    best = latest_per_key(keyed, list(keys), order, [c for c in cols if c not in keys])
    return best.select(*cols).unionByName(movies.filter(F.col(keys[0]).isNull()))


def trim_outliers(movies: DataFrame, cols=("budget", "revenue"), q: float = 0.99,
                  drop_null: bool = True) -> DataFrame:
    """Drop rows above the q-quantile of each column (V8).

    The caps are scalar subqueries (one aggregate, evaluated once, planned
    in the same query -- no driver round trip). ``drop_null=True`` keeps the
    reference's behaviour of also dropping rows where a column is NULL.
    """
    # exact at any size; one scalar subquery for all caps
    found = exact_quantiles(movies, list(cols), [q])
    caps = found.agg(F.struct(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in cols])).scalar()
    cond = F.lit(True)
    for c in cols:
        ok = F.col(c) <= caps[c]
        cond = cond & (ok if drop_null else (F.col(c).isNull() | ok))
    return movies.filter(cond)
