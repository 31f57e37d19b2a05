"""Physical-plan properties of the registered queries (after AQE), on the
smallest driver folder: the scale decisions stay in the plans."""

import pytest

from conftest import SF_SMALL

# queries whose work happens before the returned plan (streams, eager
# writes) or inside Spark ML are checked elsewhere
SKIP = {"stream_ingest", "stream_rejects", "stream_seen", "stream_seen_state", "stream_latest", "stream_seen_items", "reject_rows", "log_from_latest",
        "als_rmse", "als_topk", "als_metrics", "als_lists", "als_fold_in", "als_live_lists", "credits_csv", "links_csv"}


@pytest.fixture(scope="module")
def plans(spark):
    from cinestat.plans import registry
    from tools.plan_report import summarize
    out = {}
    for name, q in registry.REGISTRY.items():
        if name not in SKIP:
            out[name] = summarize(q.fn(spark, SF_SMALL))
    return out


def test_no_cross_joins_or_python_udfs(plans):
    for name, s in plans.items():
        assert s["nested_loop_joins"] == 0, name
        assert s["python_udfs"] == 0, name


def test_per_group_top_k_limits_before_the_shuffle(plans):
    for name in ("unseen_topk", "titled_topk", "prefix_cutoff"):
        assert plans[name]["window_group_limits"] > 0, name


def test_fact_side_aggregates_are_hash_based(plans):
    for name in ("rating_stats", "rating_histogram", "price_histogram", "value_histograms", "roi_stats",
                 "genre_roi", "genre_roi_winsor", "seen_sets", "orphan_topk", "director_roi", "actor_roi"):
        assert plans[name]["sort_aggregates"] == 0, name


def test_reports_of_several_columns_share_their_passes(plans):
    # ranges and counts: one scan each, whatever the number of columns
    assert len(plans["value_histograms"]["scans"]) <= 2


def test_scans_read_only_needed_columns(plans):
    scans = dict((src.split("-")[1] if src.startswith("silver-") else src, schema)
                 for src, _, schema in plans["rating_stats"]["scans"])
    assert scans["ratings"] == "struct<movie_id:bigint,rating:double>"
    pf = [(src, pushed) for src, pushed, _ in plans["prefix_cutoff"]["scans"]]
    assert any("EqualTo(event_type,error)" in pushed for _, pushed in pf)
    # the numbering reads its written key table; the fact table was read once, before
    ids = [src for src, _, _ in plans["id_increment"]["scans"]]
    assert any(src.startswith("ids-ranged") for src in ids) and not any(src.startswith("lineitem") for src in ids)


def test_stored_buckets_join_without_a_shuffle(spark):
    from cinestat.plans import registry
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.REGISTRY["ratings_enriched_stored"].fn(spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
        assert "Exchange" not in plan
        assert df.count() == registry.REGISTRY["ratings_enriched"].fn(spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
