"""Recommendation layer: training set, factor model, hold-out error, top-k
lists, exclusion of seen items, titled lists (M1-M5, J7, J8, W2, W3,
V29-V31, D3s, D17, D22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinestat.operators.inner_product import top_inner_products
from cinestat.operators.topk import top_k_per_group
from cinestat.sources.io import load_als, save_model


def flatten(rec_lists: DataFrame) -> DataFrame:
    """user_id, recommendations[movie_id, rating] -> user_id, movie_id, score."""
    return (rec_lists.select("user_id", F.explode("recommendations").alias("rec"))
            .select("user_id", F.col("rec.movie_id").alias("movie_id"), F.col("rec.rating").alias("score")))


def rec_ids(recs: DataFrame) -> DataFrame:
    """Distinct user ids and movie ids of a recommendation set, as (kind, id) (V31, D1s)."""
    users = recs.select(F.lit("user").alias("kind"), F.col("user_id").cast("long").alias("id")).distinct()
    movies = recs.select(F.lit("movie").alias("kind"), F.col("movie_id").cast("long").alias("id")).distinct()
    return users.unionByName(movies)


def unseen_top_k(recs: DataFrame, seen: DataFrame, users: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Top-k unseen recommendations per user.

    ``recs``: user_id, movie_id, score. ``seen``: user_id, movie_id pairs to
    exclude (recent events, full history, or both). ``users``: user_id list to
    answer for; users without recommendations get an empty list and zeros.
    Output: user_id, recommendations (movie ids in rank order, comma-joined),
    n_candidates, n_seen, filtered_count (= candidates - returned, as the
    service reported it).
    """
    # a flag for seen candidates; the planner prunes it apart for the counts and for the lists
    seen_pairs = seen.select("user_id", "movie_id").distinct().withColumn("_hit", F.lit(1))
    return unseen_of_flagged(recs.select("user_id", "movie_id", "score").join(seen_pairs, ["user_id", "movie_id"], "left"), users, k)


def unseen_of_flagged(flagged: DataFrame, users: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The same from candidates with ``_hit``, not null where seen."""
    unseen = flagged.filter(F.col("_hit").isNull()).drop("_hit")
    top = top_k_per_group(unseen, ["user_id"], [F.desc("score"), F.asc("movie_id")], k, rank_col="rank")
    listed = (top.groupBy("user_id")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "movie_id"))).alias("_l"))
              .select("user_id", F.array_join(F.transform("_l", lambda x: x["movie_id"].cast("string")), ",")
                      .alias("recommendations"),
                      F.size("_l").alias("_n_final")))
    out = flagged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count("_hit").alias("n_seen"))
    if users is not None:
        out = users.select("user_id").distinct().join(out, "user_id", "left")
    out = out.join(listed, "user_id", "left")
    n_cand = F.coalesce(F.col("n_candidates"), F.lit(0))
    return out.select("user_id",
                      F.coalesce(F.col("recommendations"), F.lit("")).alias("recommendations"),
                      n_cand.alias("n_candidates"),
                      F.coalesce(F.col("n_seen"), F.lit(0)).alias("n_seen"),
                      (n_cand - F.coalesce(F.col("_n_final"), F.lit(0))).alias("filtered_count"))


def titled_top_k(recs: DataFrame, metadata: DataFrame, k: int = 10, user_id: int | None = None) -> DataFrame:
    """Top-k recommendations with titles.

    Keys are compared as text (the metadata id is text). With ``user_id`` the
    filter is applied to the recommendations before the join, so it reaches
    the scan."""
    r = recs if user_id is None else recs.filter(F.col("user_id") == user_id)
    j = (r.withColumn("movie_key", F.col("movie_id").cast("string"))
         .join(metadata.select(F.col("id").alias("movie_key"), "title", "genres"), "movie_key"))
    return top_k_per_group(j, ["user_id"], [F.desc("score"), F.asc("movie_id")], k, rank_col="rank") \
        .select("user_id", "rank", "movie_id", "title", "genres", "score")


def training_set(history: DataFrame, ingested: DataFrame | None = None) -> DataFrame:
    """One rating per (user, movie): the latest observation.

    ``history`` and ``ingested`` carry user_id, movie_id, rating, ts and a
    tie-break column ``seq`` (later wins; the rating breaks any remaining tie).
    Ingested events win ties on ts over history. ``max_by`` pre-aggregates per map task, so a heavy user
    or movie is not sorted in one task.

    The ordering is a struct because its last tie-break is a double (repeated
    line numbers in the source give equal (ts, seq) with different ratings),
    and no fixed-width packing orders doubles exactly; Spark therefore plans a
    sort-based aggregate, still with a partial phase before the shuffle.
    """
    cols = ["user_id", "movie_id", "rating", "ts", "seq"]
    h = history.select(*cols, F.lit(0).alias("src"))
    u = h if ingested is None else h.unionByName(ingested.select(*cols, F.lit(1).alias("src")))
    counted = u.groupBy("user_id", "movie_id").agg(
        F.max_by(F.struct("rating", "ts"), F.struct("ts", "src", "seq", "rating")).alias("_b"),
        F.count(F.lit(1)).alias("n_obs"))
    return counted.select("user_id", "movie_id", F.col("_b.rating").alias("rating"),
                          F.col("_b.ts").alias("ts"), "n_obs")


def key_digit(keys: list[str], seed: int, buckets: int) -> Column:
    """A bucket from the first 32 bits of md5('key|key|...|seed'): it depends on
    the keys alone, and any engine with md5 gives the same one."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % buckets


def hash_split(ratings: DataFrame, train_pct: int = 80, seed: int = 42) -> DataFrame:
    """Adds ``is_train`` from a hash of (user, movie, seed) (D3s).

    Unlike ``randomSplit`` the assignment depends only on the row's key, so
    it is stable under repartitioning, retries and lost executors."""
    return ratings.withColumn("is_train", key_digit(["user_id", "movie_id"], seed, 100) < train_pct)


def random_split(ratings: DataFrame, weights=(0.8, 0.2), seed: int = 42):
    """``randomSplit`` as the reference uses it (D3s)."""
    return ratings.randomSplit(list(weights), seed=seed)


# The factor model's settings in the reference job.
ALS_PARAMS = {"rank": 30, "maxIter": 20, "regParam": 0.1, "coldStartStrategy": "drop"}


def fit_als(train: DataFrame, seed: int = 42, **overrides):
    """Explicit-feedback ALS on user_id, movie_id, rating (M1). Ids must fit int."""
    from pyspark.ml.recommendation import ALS
    params = {**ALS_PARAMS, **overrides}
    als = ALS(userCol="user_id", itemCol="movie_id", ratingCol="rating", seed=seed, **params)
    return als.fit(train.select(F.col("user_id").cast("int"), F.col("movie_id").cast("int"),
                                F.col("rating").cast("float")))


def holdout_rmse(model, test: DataFrame) -> DataFrame:
    """n_scored, rmse on the hold-out (M2, M3, A17): unseen users and items
    are dropped by the cold-start rule. An aggregate, not a driver action."""
    pred = model.transform(test.select(F.col("user_id").cast("int"), F.col("movie_id").cast("int"),
                                       F.col("rating").cast("float")))
    return pred.agg(F.count(F.lit(1)).alias("n_scored"),
                    F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"))


def recommend_all(model, k: int = 10) -> DataFrame:
    """Top-k items for every user in the model's stored shape (M4)."""
    return model.recommendForAllUsers(k).select(
        "user_id", F.transform("recommendations",
                               lambda r: F.struct(r["movie_id"].alias("movie_id"), r["rating"].alias("rating")))
        .alias("recommendations"))


def recommend_subset(model, users: DataFrame, k: int = 10) -> DataFrame:
    """Top-k items only for the given users (active users), not all users."""
    return model.recommendForUserSubset(users.select(F.col("user_id").cast("int")), k)


class IndexedALS:
    """An ALS model over dense int indexes of 64-bit user / item keys.

    ALS needs int ids. Each side's distinct keys get consecutive indexes
    (``ids.consecutive_ids``: range-partitioned, no single-task window); the
    dictionaries are written once to the shared checkpoint folder so fit,
    scoring and recommendation all see the same numbering, and results are
    joined back to the original keys."""

    def __init__(self, model, users: DataFrame, items: DataFrame):
        self.model, self.users, self.items = model, users, items

    def save(self, path: str) -> None:
        """The model and both dictionaries below ``path``."""
        save_model(self.model, f"{path}/model")
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.items.write.mode("overwrite").parquet(f"{path}/items")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IndexedALS:
        return cls(load_als(f"{path}/model"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items"))

    def factors(self) -> tuple[DataFrame, DataFrame]:
        """(user_id, features) and (item_id, features) under the original keys."""
        u = self.model.userFactors.select(F.col("id").alias("u_idx"), "features").join(self.users, "u_idx")
        i = self.model.itemFactors.select(F.col("id").alias("i_idx"), "features").join(self.items, "i_idx")
        return u.select("user_id", "features"), i.select(F.col("movie_id").alias("item_id"), "features")

    def top_lists(self, k: int = 10) -> DataFrame:
        """user_id, rank, movie_id, score: the exact top k of every user (M4)."""
        users, items = self.factors()
        return top_inner_products(users, items, k).withColumnRenamed("item_id", "movie_id")

    def transform(self, df: DataFrame) -> DataFrame:
        """Predictions for (user_id, movie_id) rows; unknown keys drop out (inner joins)."""
        j = df.join(self.users, "user_id").join(self.items, "movie_id")
        return self.model.transform(j.withColumn("rating", F.col("rating").cast("float")))


def fit_als_indexed(train: DataFrame, seed: int = 42, **overrides) -> IndexedALS:
    """ALS (M1) on any integral key range: keys are indexed first."""
    from pyspark.ml.recommendation import ALS
    from cinestat.operators.ids import consecutive_ids
    from cinestat.session import materialize
    users = materialize(consecutive_ids(train.select("user_id").distinct(), ["user_id"], "u_idx", start=0)
                        .select("user_id", F.col("u_idx").cast("int")), "als-users")
    items = materialize(consecutive_ids(train.select("movie_id").distinct(), ["movie_id"], "i_idx", start=0)
                        .select("movie_id", F.col("i_idx").cast("int")), "als-items")
    params = {**ALS_PARAMS, **overrides}
    als = ALS(userCol="u_idx", itemCol="i_idx", ratingCol="rating", seed=seed, **params)
    t = train.join(users, "user_id").join(items, "movie_id").select(
        "u_idx", "i_idx", F.col("rating").cast("float"))
    return IndexedALS(als.fit(t), users, items)


def holdout_rmse_indexed(model: IndexedALS, test: DataFrame) -> DataFrame:
    """n_scored, rmse, and the rmse of always predicting the hold-out's own
    mean, for an indexed model (M2, M3)."""
    pred = model.transform(test).filter(~F.isnan("prediction"))
    return pred.agg(F.count(F.lit(1)).alias("n_scored"),
                    F.sqrt(F.avg(F.pow(F.col("rating") - F.col("prediction"), 2))).alias("rmse"),
                    F.stddev_pop("rating").alias("rmse_of_mean"))
