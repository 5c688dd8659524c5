"""Exact distributed order statistics against Spark's single-task built-ins."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from tidewater.operators.order_stats import (above_cutoff, exact_median, exact_percent_rank, exact_quantiles,
                                             percent_rank_thresholds)


def _frame(spark, values, groups=1):
    rows = [(i % groups, float(v) if v is not None else None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g int, v double")


@pytest.mark.parametrize("seed,n,dup", [(1, 1, 1), (2, 2, 1), (3, 57, 5), (4, 400, 3), (5, 1000, 1000)])
def test_percent_rank_matches_builtin(spark, seed, n, dup):
    rnd = random.Random(seed)
    vals = [rnd.randrange(dup) if rnd.random() > 0.05 else None for _ in range(n)]
    df = _frame(spark, vals).withColumn("id", F.monotonically_increasing_id())
    for desc in (False, True):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        ref = {r.id: r.p for r in df.select("id", F.percent_rank().over(W.orderBy(order)).alias("p")).collect()}
        got = {r.id: r.p for r in exact_percent_rank(df, "v", "p", descending=desc, buckets=8).select("id", "p").collect()}
        assert got == ref


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_thresholds_match_case_over_percent_rank(spark, seed):
    rnd = random.Random(seed)
    vals = [rnd.randrange(30) if rnd.random() > 0.1 else None for _ in range(rnd.randrange(1, 200))]
    df = _frame(spark, vals).withColumn("id", F.monotonically_increasing_id())
    cut = (0.25, 0.5, 0.75)
    for desc in (False, True):
        order = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        pr = F.percent_rank().over(W.orderBy(order))
        ref = {r.id: tuple(r)[1:] for r in df.select("id", *[(pr > q).alias(f"c{i}") for i, q in enumerate(cut)]).collect()}
        thr = percent_rank_thresholds(df, {"v": desc}, cut)
        thr = thr.select(*[F.col(c).alias("t_" + c) for c in thr.columns])
        j = df.crossJoin(F.broadcast(thr))
        got = {r.id: tuple(r)[1:] for r in j.select("id", *[above_cutoff(F.col("v"), "t_", i, desc).alias(f"c{i}")
                                                            for i in range(3)]).collect()}
        assert got == ref


@pytest.mark.parametrize("max_exact", [10 ** 9, 5])
def test_grouped_median_and_quantiles(spark, max_exact):
    rnd = random.Random(7)
    vals = [rnd.randrange(50) if rnd.random() > 0.1 else None for _ in range(300)]
    df = _frame(spark, vals, groups=4)
    ref = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = {r.g: r.median for r in exact_median(df, ["g"], "v", buckets=4, max_exact_rows=max_exact).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        assert got[k] == pytest.approx(ref[k])
    q = exact_quantiles(df, ["g"], "v", [0.1, 0.9], ["a", "b"], buckets=4, max_exact_rows=max_exact).collect()
    ref_q = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.1).alias("a"),
                                                          F.percentile("v", 0.9).alias("b")).collect()}
    for r in q:
        assert (r.a, r.b) == pytest.approx(ref_q[r.g])


def test_buckets_follow_the_order(spark):
    from tidewater.operators.order_stats import octave
    inf, nan = float("inf"), float("nan")
    vals = sorted([0.0, 5e-324, 1e-300, 1.0, 1.0000000001, 2.0, 1e300, 1.7e308, 3.14, 99.5, inf] + [-x for x in (5e-324, 1e-300, 1.0, 1.0000000001, 1e300, 3.14, inf)]) + [nan]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r.b for r in df.select("i", octave(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
    for f in (0.0, 0.3, 0.5, 1.0):
        q = exact_quantiles(df.where("NOT isnan(v) AND abs(v) < 1e299"), [], "v", [f], ["q"], buckets=4, max_exact_rows=1).first().q
        assert q == df.where("NOT isnan(v) AND abs(v) < 1e299").agg(F.percentile("v", f)).first()[0]


def test_hot_group_is_refined(spark):
    # one group holds most rows and a single repeated value; refinement must stay exact
    vals = [5] * 500 + list(range(100))
    df = _frame(spark, vals, groups=1)
    ref = df.agg(F.median("v")).first()[0]
    got = exact_median(df, ["g"], "v", buckets=4, max_exact_rows=20).first().median
    assert got == ref


def test_single_value_bucket_resolved_without_refinement(spark):
    # a third of the rows share one value: its bucket cannot be split, the answer is read off the range
    vals = [1] * 400 + list(range(2, 802))
    df = _frame(spark, vals, groups=1)
    ref = df.agg(F.percentile("v", [0.1, 0.5, 0.9])).first()[0]
    got = exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"], buckets=4, max_exact_rows=10).first()
    assert [got.a, got.b, got.c] == pytest.approx(ref)


def test_repeated_rows_keep_their_number(spark):
    from tidewater.operators.order_stats import exact_percent_ranks
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 5.0), ("b", 2.0, None), ("a", None, 5.0)], "g string, u double, v double")
    want = df.withColumns({"pu": F.percent_rank().over(W.partitionBy("g").orderBy("u")),
                           "pv": F.percent_rank().over(W.partitionBy("g").orderBy(F.col("v").desc_nulls_last()))})
    got = exact_percent_ranks(df, {"u": ("pu", False), "v": ("pv", True)}, keys=["g"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001/lineitem.parquet"), reason="no driver data")
def test_sheet_medians_on_driver_tables_all_paths(spark):
    """Medians of the sheet cells (sheet x level x entity x year groups) from
    the driver tables, by rolled-up histograms and by groups of their own,
    equal Spark's single-buffer ``median``."""
    from tidewater.plans import sheets as SH
    from tidewater.sources.tables import Tables
    s = SH.star_from(Tables(spark, "/root/testdata/sf0.001"))
    rows = SH.sheet_rows(s)
    lv = rows.join(F.broadcast(SH.entity_levels(s)), "__nk")
    keys = ["sheet", "level", "code", "year"]
    ref = {tuple(r[:4]): (r[4], r[5]) for r in lv.groupBy(*keys).agg(F.median("v"), F.count("v")).collect()}
    for max_exact, buckets in [(10 ** 9, 128), (200, 16), (20, 4)]:
        got = {tuple(r[:4]): (r[4], r[5]) for r in exact_quantiles(lv, keys, "v", [0.5], ["m"],
                                                                   max_exact_rows=max_exact, buckets=buckets).collect()}
        assert got.keys() == ref.keys()
        for k, (m, n) in ref.items():
            assert got[k][1] == n and got[k][0] == pytest.approx(m, abs=1e-9)
    for bounds in ({}, {"max_exact_rows": 3, "buckets": 4}):
        got = {(r.sheet, r.level, r.code, r.year): (r["median"], r.n_obs) for r in SH.sheet_cells(s, **bounds).collect()}
        assert got.keys() == ref.keys()
        for k, (m, n) in ref.items():
            assert got[k][1] == n and got[k][0] == pytest.approx(m, abs=1e-9)
