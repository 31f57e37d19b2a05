"""Rating statistics and their link to catalogue metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinestat.operators.recommend import key_digit
from cinestat.operators.topk import top_k


def rating_stats(ratings: DataFrame, key: str = "movie_id") -> DataFrame:
    """rating_count, rating_mean, rating_std (sample; NULL for one rating) per movie.

    All three are algebraic, so every map task pre-aggregates before the
    shuffle and a popular movie costs one partial row per task."""
    return ratings.groupBy(key).agg(F.count(F.lit(1)).alias("rating_count"),
                                    F.avg("rating").alias("rating_mean"),
                                    F.stddev("rating").alias("rating_std"))


def stats_by_catalogue_id(ratings: DataFrame, links: DataFrame) -> DataFrame:
    """Rating stats re-keyed to the catalogue id.

    Several rating ids can map to one catalogue id; combining per catalogue
    id gives the count-weighted mean instead of counting the film twice
    downstream. Ratings are reduced per rating id first (count, mean, variance --
    map-side partial aggregation, so a hot movie is one row per task), and only
    those rows meet the links. The squared deviations from the combined mean
    add up without the cancellation that a sum of squares would suffer.
    """
    ln = links.filter(F.col("tmdbId").isNotNull()).select(F.col("movieId").alias("movie_id"),
                                                           F.col("tmdbId").alias("tmdb_id"))
    r = F.col("rating").cast("double")
    per_id = ratings.filter(r.isNotNull()).groupBy("movie_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(r).alias("_m"), F.var_pop(r).alias("_v"))
    film = Window.partitionBy("tmdb_id")
    rows = per_id.join(ln, "movie_id").withColumn("_n_all", F.sum("_n").over(film)).withColumn(
        "_mean", F.sum(F.col("_n") * F.col("_m")).over(film) / F.col("_n_all"))
    away = F.col("_m") - F.col("_mean")
    # the aggregate keeps the window's partitioning: no further shuffle
    return (rows.groupBy("tmdb_id")
            .agg(F.max("_n_all").alias("rating_count"), F.max("_mean").alias("rating_mean"),
                 F.sum(F.col("_n") * (F.col("_v") + away * away)).alias("_m2"))
            # NULL for one rating
            .select("tmdb_id", "rating_count", "rating_mean",
                    F.sqrt(F.try_divide("_m2", F.col("rating_count") - 1)).alias("rating_std")))


METADATA = ("title", "vote_average", "vote_count", "release_year")


def metadata_lookup(links: DataFrame, movies_primary: DataFrame, movies_backup: DataFrame) -> DataFrame:
    """movie_id, tmdb_id and the metadata of every linked rating id.

    One aggregate over both catalogues keeps a primary and a backup row per
    catalogue id (of several the one with most votes); each column is the
    primary's or else the backup's. The links then meet one row per catalogue
    id, so no join can multiply rows, and the table can be stored and used by
    every report."""
    ranked = [films.where(F.col("tmdb_id").isNotNull())
              .select("tmdb_id", F.lit(main).alias("main"), F.coalesce(F.col("vote_count").cast("long"), F.lit(-1)).alias("votes"),
                      F.struct(*METADATA).alias("row")) for films, main in ((movies_primary, True), (movies_backup, False))]
    best = lambda mine: F.max_by(F.when(mine, F.col("row")), F.when(mine, F.col("votes")))
    films = ranked[0].unionByName(ranked[1]).groupBy("tmdb_id").agg(best(F.col("main")).alias("p"), best(~F.col("main")).alias("b")) \
        .select("tmdb_id", *(F.coalesce(F.col("p")[c], F.col("b")[c]).alias(c) for c in METADATA))
    known = links.where(F.col("tmdbId").isNotNull()).select(F.col("movieId").cast("long").alias("movie_id"), F.col("tmdbId").alias("tmdb_id"))
    return known.join(films, "tmdb_id", "left")


def with_metadata(stats: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rating stats with the looked-up metadata, one row per ``stats`` row."""
    return stats.join(lookup, "movie_id", "left").select(
        "movie_id", "tmdb_id", "title", "rating_count", "rating_mean", "rating_std", "vote_average", "vote_count", "release_year",
        (F.col("vote_average") / 2.0).alias("tmdb_rating_5"))


def enrich_ratings(stats: DataFrame, links: DataFrame, movies_primary: DataFrame,
                   movies_backup: DataFrame) -> DataFrame:
    """Rating stats with metadata out of the cleaned movies or, column by column,
    the uncleaned ones (V19, J4-J6, F16)."""
    return with_metadata(stats, metadata_lookup(links, movies_primary, movies_backup))


def enrichment_nulls(enriched: DataFrame) -> DataFrame:
    """NULL counts after enrichment (A3)."""
    return enriched.agg(F.count(F.lit(1)).alias("n"),
                        F.count_if(F.col("title").isNull()).alias("null_title"),
                        F.count_if(F.col("vote_average").isNull()).alias("null_vote_avg"),
                        F.count_if(F.col("release_year").isNull()).alias("null_release_year"))


def most_rated(enriched: DataFrame, k: int = 10) -> DataFrame:
    """Titled movies with the most ratings."""
    return top_k(enriched.filter(F.col("title").isNotNull()),
                 [F.desc("rating_count"), F.asc("movie_id")], k).select("movie_id", "title", "rating_count",
                                                                         "rating_mean")


def best_rated(enriched: DataFrame, min_votes: int, k: int = 10) -> DataFrame:
    """Highest mean rating among titled movies with >= min_votes ratings."""
    f = enriched.filter(F.col("title").isNotNull() & (F.col("rating_count") >= min_votes))
    return top_k(f, [F.desc("rating_mean"), F.asc("movie_id")], k).select("movie_id", "title", "rating_count",
                                                                           "rating_mean")


def source_correlation(enriched: DataFrame) -> DataFrame:
    """Pearson correlation of the two rating sources on one 0-5 scale.

    ``corr`` drops pairs with a NULL (``stat.corr`` would count NULL as 0)."""
    f = enriched.filter(F.col("tmdb_rating_5").isNotNull() & F.col("rating_mean").isNotNull())
    return f.agg(F.count(F.lit(1)).alias("n"), F.corr("rating_mean", "tmdb_rating_5").alias("corr"))


def popularity_vs_rating(enriched: DataFrame) -> DataFrame:
    """(rating_count, rating_mean) pairs without NULLs."""
    return enriched.select("movie_id", "rating_count", "rating_mean").dropna()


def ratings_by_year(enriched: DataFrame) -> DataFrame:
    """Movies with ratings and their mean rating per release year."""
    return (enriched.filter(F.col("release_year").isNotNull()).groupBy("release_year")
            .agg(F.count(F.lit(1)).alias("num_movies_rated"), F.avg("rating_mean").alias("avg_rating_mean"))
            .orderBy("release_year"))


def sample_ratings(ratings: DataFrame, fraction: float, seed: int | None = 42) -> DataFrame:
    """Bernoulli sample without replacement (D4s); per-partition, no shuffle."""
    return ratings.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(rows: DataFrame, keys: list[str], per_mille: int, seed: int = 42) -> DataFrame:
    """The rows whose keys hash into the first ``per_mille`` of 1000 buckets
    (D4s): the same rows at every partitioning, no shuffle."""
    return rows.where(key_digit(keys, seed, 1000) < per_mille)
