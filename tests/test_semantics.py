"""Semantics decisions of SURVEY section 2.14 not covered elsewhere, one
test each on hand-written rows (D3, D5, D7, D12, D13, D16, D18)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinestat.functions.casts import try_number
from cinestat.operators import clean, people, quantile, recommend
from cinestat.operators import ratings as R


def test_d3_p99_trim_removes_the_top_percent(spark):
    """p99 with accuracy 10000 trims the top 1 %; a coarse sketch (relative
    error about 0.05) may return the maximum and trim nothing."""
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("budget"),
                                     F.col("id").cast("double").alias("revenue"))
    assert clean.trim_outliers(df).count() == 990
    coarse = df.agg(F.percentile_approx("budget", 0.99, 20).alias("p")).first().p
    assert coarse >= 990


def test_d5_backup_metadata_never_fans_out(spark):
    """Two backup rows for one catalogue id: the enrichment still returns one
    row per rating id, taking the backup row with more votes."""
    stats = spark.createDataFrame([(11, 3, 4.0, 1.0), (12, 1, 2.0, None)],
                                  "movie_id long, rating_count long, rating_mean double, rating_std double")
    links = spark.createDataFrame([(11, 1), (12, 2)], "movieId int, tmdbId int")
    primary = spark.createDataFrame([], "tmdb_id int, title string, vote_average double, vote_count int, "
                                        "release_year int")
    backup = spark.createDataFrame([(1, "a", 6.0, 10, 2000), (1, "b", 8.0, 50, 2001), (2, "c", 5.0, 1, 1999)],
                                   "tmdb_id int, title string, vote_average double, vote_count int, release_year int")
    out = {r.movie_id: r for r in R.enrich_ratings(stats, links, primary, backup).collect()}
    assert len(out) == 2
    assert (out[11].title, out[11].vote_count, out[11].tmdb_rating_5) == ("b", 50, 4.0)


def test_d7_ansi_stays_on_and_bad_text_becomes_null(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("12",), (" 3.5 ",), ("abc",), ("",), (None,)], "v string")
    got = [r.x for r in df.select(try_number("v").alias("x")).collect()]
    assert got == [12.0, 3.5, None, None, None]
    with pytest.raises(Exception):
        df.select(F.col("v").cast("double")).collect()


def test_d12_explode_drops_empty_and_counts_repeats(spark):
    """Films without directors vanish; a person credited twice on one film
    counts twice unless names are made distinct first."""
    pt = spark.createDataFrame([(1, ["x", "x"], ["a"]), (2, ["x", "y"], []), (3, [], ["a"]), (4, None, None)],
                               "tmdb_id int, directors array<string>, cast array<string>")
    films = pt.select("tmdb_id")
    assert {r.director: r.n for r in people.person_report(films, pt, "director").collect()} == {"x": 3, "y": 1}
    assert {r.actor: r.n for r in people.person_report(films, pt, "actor").collect()} == {"a": 2}
    assert {r.actor: r.n for r in people.person_report(films, pt, "actor", directed_only=True).collect()} == {"a": 1}


def test_d13_exact_median_interpolates_approx_does_not(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    exact = quantile.exact_percentile(df, "v", 0.5).first().percentile
    approx = df.agg(F.percentile_approx("v", 0.5, 10000).alias("p")).first().p
    assert (exact, approx) == (500.5, 500.0)


def test_d16_exclusion_takes_any_seen_table(spark):
    """The exclusion table can be recent events, the full history or both."""
    recs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.6)],
                                 "user_id long, movie_id long, score double")
    recent = spark.createDataFrame([(1, 10)], "user_id long, movie_id long")
    history = spark.createDataFrame([(1, 11)], "user_id long, movie_id long")
    only_recent = recommend.unseen_top_k(recs, recent, k=2).first()
    both = recommend.unseen_top_k(recs, recent.unionByName(history), k=2).first()
    assert only_recent.recommendations == "11,12" and both.recommendations == "12,13"
    assert (both.n_candidates, both.n_seen, both.filtered_count) == (4, 2, 2)


def test_d18_corr_drops_pairs_with_a_null(spark):
    rows = [(1.0, 1.1), (2.0, 2.2), (3.0, None), (None, 4.0), (4.0, 3.9), (5.0, 5.2)]
    df = spark.createDataFrame(rows, "rating_mean double, tmdb_rating_5 double")
    got = R.source_correlation(df).first()
    pdf = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    assert got.n == 4
    assert got.corr == pytest.approx(float(np.corrcoef(pdf.a, pdf.b)[0, 1]), rel=1e-12)
    # counting a NULL as 0 (what a driver-side stat.corr on filled values gives) differs
    filled = pd.DataFrame(rows, columns=["a", "b"]).fillna(0.0)
    assert not math.isclose(got.corr, float(np.corrcoef(filled.a, filled.b)[0, 1]), rel_tol=1e-3)


def test_exact_global_percentile_edge_cases(spark):
    """A9 global path (two narrowing levels): two values, heavy duplicates,
    a value holding a third of the rows, extreme p, a coarse sketch."""
    import random
    rng = random.Random(11)
    cases = [[1.0, 2.0], [float(rng.randint(0, 5)) for _ in range(2000)],
             [7.0] * 700 + [rng.gauss(0, 100) for _ in range(1400)]]
    for vals in cases:
        df = spark.createDataFrame([(v,) for v in vals], "v double").repartition(3)
        for acc in (50,):  # a coarse sketch has the widest margins
            for p in (0.0, 0.37, 1.0):
                got = quantile.exact_percentile(df, "v", p, accuracy=acc).first().percentile
                assert got == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12), (len(vals), acc, p)
