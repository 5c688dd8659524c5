"""Hand-made rows, one small set per semantic trap."""

import datetime as dt

from pyspark.sql import Window as W, functions as F

from tidewater.functions.binning import bands_frame, bin_labels, fixed_bins
from tidewater.functions.dates import add_years, day_diff, shifted_open_range
from tidewater.functions.na import not_in_keep_null, sum_strict
from tidewater.functions.text import like_class, share_label
from tidewater.operators.joins import band_join, join_null_safe
from tidewater.operators.reshape import clean_long
from tidewater.operators.series import lag_pct_change, running_total
from tidewater.operators.topk import arg_extreme, top_n, with_remainder
from tidewater.plans.affordability import median_impute
from tidewater.plans.customers import SEGMENT_RULES, segment_of


def test_strict_shifted_bounds_and_leap_day(spark):
    rows = [(1, dt.datetime(2013, 1, 1, 0, 0, 0)), (2, dt.datetime(2013, 1, 1, 0, 0, 1)),
            (3, dt.datetime(2013, 12, 31, 23, 59, 59)), (4, dt.datetime(2014, 1, 1)),
            (5, dt.datetime(2012, 2, 29, 13, 0))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz")
    kept = df.where(shifted_open_range("ts", "2023-01-01", "2024-01-01", 10)).select("id").collect()
    assert sorted(r.id for r in kept) == [2, 3]
    leap = df.where("id = 5").select(add_years("ts", 10).alias("s")).first().s
    assert leap == dt.datetime(2022, 2, 28, 13, 0)


def test_day_diff_argument_order(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), dt.datetime(2023, 1, 3, 23, 0))], "a date, b timestamp_ntz")
    assert df.select(day_diff("a", "b").alias("d")).first().d == 2


def test_label_rules_cover_all_scores_first_match(spark):
    scores = [f"{r}{f}{m}" for r in range(1, 5) for f in range(1, 5) for m in range(1, 5)]
    df = spark.createDataFrame([(s,) for s in scores], "rfm_score string")
    got = {r.rfm_score: r.segment for r in df.select("rfm_score", segment_of().alias("segment")).collect()}
    assert got["111"] == "Best Customers"        # also matches [1-2][1-3]1
    assert got["211"] == "Almost Lost"            # also matches [1-2][1-3]1
    assert "unknown" not in got.values()
    counts = {}
    for v in got.values():
        counts[v] = counts.get(v, 0) + 1
    assert counts == {"Best Customers": 1, "Lost Bad Customer": 16, "Lost Customers": 8, "Almost Lost": 4,
                      "Loyal Customers": 3, "Big Spenders": 4, "New Customers": 8, "Hibernating": 8,
                      "Potential Loyalists": 12}
    assert len(SEGMENT_RULES) == 9


def test_like_class_is_not_literal(spark):
    df = spark.createDataFrame([("321",), ("[3-4]2[1-4]",)], "s string")
    assert [r.s for r in df.where(like_class("s", "[3-4]2[1-4]")).collect()] == ["321"]


def test_lag_change_previous_row_zero_and_single(spark):
    df = spark.createDataFrame([("a", 2000, 10.0), ("a", 2002, 0.0), ("a", 2003, 5.0), ("b", 2000, 3.0)],
                               "e string, y int, v double")
    out = {(r.e, r.y): r.pct for r in lag_pct_change(df, "e", "y", "v", "pct").collect()}
    assert out[("a", 2000)] is None
    assert out[("a", 2002)] == -100.0           # previous row, not previous year
    assert out[("a", 2003)] is None             # zero base
    assert out[("b", 2000)] is None


def test_running_total_null_poisons(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 5.0)], "e string, y int, v double")
    out = [r.c for r in running_total(df, "e", "y", "v", "c").orderBy("y").collect()]
    assert out == [1.0, None, None]
    loose = [r.c for r in running_total(df, "e", "y", "v", "c", strict=False).orderBy("y").collect()]
    assert loose == [1.0, 1.0, 6.0]


def test_top_with_remainder_variants(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 3.0)], "e string, v double")
    total = spark.createDataFrame([(20.0,)], "total double")
    top = top_n(df, "v", 5, ["e"])
    rows = {r.e: r.v for r in with_remainder(top, "e", "v", total, "Rest").collect()}
    assert rows["Rest"] is None                 # NULL among the top poisons the sum
    df2 = df.where("v is not null")
    rows2 = {r.e: r.v for r in with_remainder(top_n(df2, "v", 5, ["e"]), "e", "v", total, "Rest").collect()}
    assert rows2["Rest"] == 12.0                # fewer than five rows
    missing = spark.createDataFrame([(1.0,)], "x double").where("x < 0").agg(F.first("x").alias("total"))
    rows3 = {r.e: r.v for r in with_remainder(top_n(df2, "v", 5, ["e"]), "e", "v", missing, "Rest").collect()}
    assert rows3["Rest"] is None                # no total row


def test_nulls_sort_last_in_top_n(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 2.0)], "e string, v double")
    assert [r.e for r in top_n(df, "v", 3, ["e"]).collect()] == ["c", "b", "a"]
    assert [r.e for r in top_n(df, "v", 3, ["e"], descending=False).collect()] == ["b", "c", "a"]


def test_unpivot_cleaning(spark):
    df = spark.createDataFrame([("x", "10", ":", "", "abc")],
                               "id string, `Year 2001` string, `Year 2002` string, `Year 2003` string, `Year 20041` string")
    out = {r.Year: r.v for r in clean_long(df, df.columns[1:], "v").collect()}
    assert out == {2001: 10.0, 2002: None, 2003: None, None: None}


def test_median_impute_odd_even_all_missing(spark):
    df = spark.createDataFrame([("g1", 1.0), ("g1", 3.0), ("g1", 10.0), ("g1", None),
                                ("g2", 1.0), ("g2", 2.0), ("g2", None),
                                ("g3", None)], "g string, v double")
    out = median_impute(df, ["g"], "v").where("g in ('g1','g2','g3')").collect()
    filled = sorted((r.g, r.v) for r in out if r.v is not None)
    assert ("g1", 3.0) in filled and ("g2", 1.5) in filled
    assert [r.v for r in out if r.g == "g3"] == [None]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted(r.x or "" for r in df.where(not_in_keep_null("x", ["a"])).collect()) == ["", "b"]


def test_arg_extreme_ties_and_all_null(spark):
    df = spark.createDataFrame([("g", "z", 1.0), ("g", "a", 1.0), ("g", "m", 3.0), ("h", "q", None)],
                               "g string, n string, v double")
    out = {r.g: (r.lo, r.hi) for r in df.groupBy("g").agg(arg_extreme("n", "v").alias("lo"),
                                                         arg_extreme("n", "v", largest=True).alias("hi")).collect()}
    assert out["g"] == ("a", "m") and out["h"] == (None, None)


def test_bins_edges(spark):
    b = (0, 5, 8, 12, 24, 44)
    df = spark.createDataFrame([(0.0,), (5.0,), (44.0,), (45.0,), (-1.0,)], "x double")
    out = [r.b for r in df.select(fixed_bins("x", b).alias("b")).collect()]
    assert out == [0, 1, 4, None, None]
    assert bin_labels(b)[-1] == "[24,44]"


def test_bands_closed_both_ends(spark):
    years = spark.createDataFrame([(2008.0,), (2013.0,), (1975.5,)], "y double")
    bands = bands_frame(spark, [("a", 1997, 2008), ("b", 2008, 2013), ("c", 2013, 2022), ("r", 1973.5, 1976)])
    out = sorted((r.y, r.band) for r in band_join(years, "y", bands).collect())
    assert out == [(1975.5, "r"), (2008.0, "a"), (2008.0, "b"), (2013.0, "b"), (2013.0, "c")]


def test_null_safe_join_and_strict_sum(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("k", 20)], "k string, b int")
    out = sorted((r.a, r.b) for r in join_null_safe(a, b, ["k"], "left").collect())
    assert out == [(1, 10), (2, 20)]
    s = spark.createDataFrame([(1.0,), (None,)], "x double").agg(sum_strict("x").alias("s")).first().s
    assert s is None


def test_share_label_format(spark):
    df = spark.createDataFrame([(11.0, 30.66), (2.675, 1.25), (None, 5.0)], "v double, p double")
    out = [r.l for r in df.select(share_label("v", "p").alias("l")).collect()]
    assert out[0] == "11 (30.7%)"
    assert out[2].startswith("NA (")


def test_window_equivalent_of_group_attach(spark):
    from tidewater.operators.joins import attach_group_agg
    df = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, v int")
    a = sorted(tuple(r) for r in attach_group_agg(df, ["k"], {"m": F.max("v")}).collect())
    b = sorted(tuple(r) for r in df.withColumn("m", F.max("v").over(W.partitionBy("k"))).collect())
    assert a == b
