"""Bitmaps of seen items, and list text as VARIANT."""

import random

from pyspark.sql import functions as F

from cinestat.functions import pseudo_json
from cinestat.operators import bitmaps


def test_bitmaps_equal_sets(spark):
    rng = random.Random(3)
    edges = [1, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 10**9, 10**12 + 7]
    pairs = [(rng.randint(1, 5), rng.choice(edges + [rng.randint(1, 200_000)]), rng.randint(1, 4)) for _ in range(400)]
    df = spark.createDataFrame(pairs + [(None, 5, 1), (1, None, 1)], "user_id long, movie_id long, day int")
    days = bitmaps.seen_bitmaps(df, "user_id", "movie_id", "day")
    whole = bitmaps.merged(days)
    assert {tuple(r) for r in bitmaps.set_sizes(whole).collect()} == {(u, len({m for v, m, _ in pairs if v == u})) for u in {p[0] for p in pairs}}
    seen = {(u, m) for u, m, _ in pairs}
    probes = {(u, m + d) for u, m, _ in pairs for d in (-1, 0, 1) if m + d > 0} | {(77, 5)}
    got = bitmaps.flagged(spark.createDataFrame(sorted(probes), "user_id long, movie_id long"), whole)
    assert got.columns == ["user_id", "movie_id", "_hit"]
    assert {(r[0], r[1]) for r in got.collect() if r[2] == 1} == seen and got.count() == len(probes)
    day = days.where("day < 3")  # a part alone
    assert {tuple(r) for r in bitmaps.set_sizes(bitmaps.merged(day)).collect()} == {
        (u, len({m for v, m, d in pairs if v == u and d < 3})) for u in {p[0] for p in pairs if p[2] < 3}}


def test_masking_needs_no_array_and_no_explode(spark):
    pairs = spark.createDataFrame([(1, 5)], "user_id long, movie_id long")
    plan = bitmaps.flagged(pairs, bitmaps.merged(bitmaps.seen_bitmaps(pairs)))._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and not any(x in plan for x in ("Generate", "collect_", "Python"))


def test_no_bitmap_is_shuffled_or_sorted(spark):
    pairs = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "user_id long, movie_id long, day int")
    plan = bitmaps.merged(bitmaps.seen_bitmaps(pairs, "user_id", "movie_id", "day"))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.rindex("bitmap_construct_agg")]  # the plan prints the last step first
    assert "Exchange" not in above and "Sort [" not in above and plan.count("Exchange") == 1


def test_variant_schema_covers_every_row(spark):
    texts = ["[{'id': 1, 'name': \"O'Brien\", 'g': None}]", "[{'id': 2, 'extra': True}]", "[]", "[{'id': 'x'", None, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = pseudo_json.schema_of_all(df, "t").first()
    assert tuple(got) == ("ARRAY<OBJECT<extra: BOOLEAN, g: VOID, id: BIGINT, name: STRING>>", 3)
    v = df.select(F.try_variant_get(pseudo_json.as_variant("t"), "$[0].name", "string").alias("n"),
                  F.try_variant_get(pseudo_json.as_variant("t"), "$[0].id", "int").alias("i"))
    assert [tuple(r) for r in v.collect()] == [("O'Brien", 1), (None, 2), (None, None), (None, None), (None, None), (None, None)]
    assert tuple(pseudo_json.schema_of_all(df.limit(0), "t").first())[1] == 0
