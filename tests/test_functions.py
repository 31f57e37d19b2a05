"""Scalar functions on hand-written rows."""

import datetime as dt

from pyspark.sql import functions as F

from cinestat import schemas as S
from cinestat.functions import casts, pseudo_json


def test_try_number_and_grouped_int(spark):
    df = spark.createDataFrame([("0",), ("",), (None,), ("1,234",), ("abc",), ("12",)], "v string")
    r = df.select(casts.try_number("v").alias("d"), casts.parse_grouped_int("v").alias("g")).collect()
    assert [x.d for x in r] == [0.0, None, None, None, None, 12.0]
    assert [x.g for x in r] == [0, None, None, 1234, None, 12]


def test_zero_to_null_and_bool(spark):
    df = spark.createDataFrame([(0.0, "True"), (5.0, "False"), (None, "x"), (1.0, None)], "v double, b string")
    r = df.select(casts.zero_to_null("v").alias("z"), casts.text_bool("b").alias("t")).collect()
    assert [x.z for x in r] == [None, 5.0, None, 1.0]
    assert [x.t for x in r] == [True, False, None, None]


def test_parse_date_and_year_flags(spark):
    df = spark.createDataFrame([("2001-02-03",), ("1",), (None,), ("1890-01-01",), ("2030-05-01",)], "d string")
    d = casts.parse_date("d", "yyyy-MM-dd")
    early, late = casts.year_flags(F.year(d))
    r = df.select(d.alias("p"), early.alias("e"), late.alias("l")).collect()
    assert r[0].p == dt.date(2001, 2, 3) and r[1].p is None and r[2].p is None
    assert [x.e for x in r] == [False, None, None, True, False]
    assert [x.l for x in r] == [False, None, None, False, True]


def test_isin_with_null_member_needs_explicit_null(spark):
    """isin('', '0', NULL) never matches NULL; the counter counts it explicitly."""
    from cinestat.operators.profile import quality_counters
    raw = spark.createDataFrame([("1", "0"), ("2", ""), ("3", None), ("4", "12")], "id string, budget string")
    naive = raw.filter(F.col("budget").isin("", "0", None)).count()
    for c in ("revenue", "runtime", "release_date", "genres"):
        raw = raw.withColumn(c, F.lit("x"))
    assert naive == 2
    assert quality_counters(raw).collect()[0].budget_zero_or_null == 3


def test_safe_ratio_winsorize_score_label(spark):
    df = spark.createDataFrame([(10.0, 2.0, "8/10", "Genre: Drama"), (0.0, 2.0, "n/a", "Year 2001"),
                                (None, 1.0, None, None), (300.0, 1.0, " 7 /10", "Genre: ")],
                               "r double, b double, s string, l string")
    r = df.select(casts.safe_ratio("r", "b").alias("roi"), casts.winsorize(casts.safe_ratio("r", "b"), 100.0)
                  .alias("w"), casts.score_text("s").alias("sc"), casts.after_label("l", "Genre: ").alias("g")).collect()
    assert [x.roi for x in r] == [5.0, None, None, 300.0]
    assert [x.w for x in r] == [5.0, None, None, 100.0]   # NULL stays NULL (least() would give the cap)
    assert [x.sc for x in r] == [8.0, None, None, 7.0]
    assert [x.g for x in r] == ["Drama", None, None, ""]


def test_pseudo_json_repair_cases(spark):
    """None as value and as word, O'Brien, inner double quotes, empty, escaped apostrophe."""
    rows = [
        ("[{'id': 1, 'name': None}]",),
        ("[{'id': 2, 'name': 'None Left'}]",),
        ("[{'id': 3, 'name': \"O'Brien\"}]",),
        ("[{'id': 4, 'name': 'a \"q\" b'}]",),
        ("[{'id': 5, 'name': ''}]",),
        ("[{'id': 6, 'name': 'It\\'s'}]",),
        ("[{'id': 7, 'name': 'x, None, y'}]",),
        ("[",),
        ("[]",),
        (None,),
    ]
    df = spark.createDataFrame(rows, "t string")
    r = df.select(pseudo_json.parse("t", S.ID_NAME_LIST).alias("p")).collect()
    names = [None if x.p is None else [e.name for e in x.p] for x in r]
    assert names == [[None], ["None Left"], ["O'Brien"], ['a "q" b'], [""], ["It's"], ["x, None, y"], None, [], None]
    # plain from_json fails on the Python constant
    plain = df.select(F.from_json("t", S.ID_NAME_LIST).alias("p")).collect()
    assert plain[0].p is None


def test_credit_text_flags_true_false(spark):
    df = spark.createDataFrame([("[{'credit_id': 'c', 'department': 'Directing', 'gender': None, 'id': 1, "
                                 "'job': 'Director', 'name': 'True Grit Fan', 'profile_path': None}]",)], "t string")
    r = df.select(pseudo_json.parse("t", S.CREW_LIST).alias("p")).collect()[0].p[0]
    assert r.name == "True Grit Fan" and r.gender is None and r.job == "Director"
