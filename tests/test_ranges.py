"""Ranges against Spark's own windows, with groups cut into many ranges."""

import datetime
import random

import pytest
from pyspark.sql import Window as W, functions as F

from tidewater.operators import ranges as R

SMALL = {"rows": 7, "grid": 15}


def frame(spark, n, seed, ties=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g = r.choice(["hot"] * 6 + ["a", None, "b"])
        day = datetime.datetime(2000, 1, 1) + datetime.timedelta(days=r.randrange(9) if ties and r.random() < 0.6 else 1000 + i)
        rows.append((i, g, None if r.random() < 0.05 else day, None if r.random() < 0.03 else float(r.randrange(40)), r.randrange(5)))
    return spark.createDataFrame(rows, "id long, g string, day timestamp_ntz, v double, extra int").repartition(3)


def same(got, want, cols):
    a = sorted((tuple(r) for r in got.select("id", *cols).collect()))
    b = sorted((tuple(r) for r in want.select("id", *cols).collect()))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[0] == y[0] and all((p is None and q is None) or (p is not None and q is not None and p == pytest.approx(q)) for p, q in zip(x[1:], y[1:])), (x, y)


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize("n", [0, 1, 400])
def test_windows(spark, keys, n):
    df = frame(spark, n, seed=n)
    w = W.partitionBy(*keys).orderBy("day", "id")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    for strict in (True, False):
        want = F.sum("v").over(upto)
        if strict:
            want = F.when(~F.bool_or(F.col("v").isNull()).over(upto), want)
        same(R.running_total(df, keys, ["day", "id"], "v", "t", strict, **SMALL), df.withColumn("t", want), ["t", "extra"])
    got = R.neighbours(df, keys, ["day", "id"], "v", "p", "f", **SMALL)
    same(got, df.withColumns({"p": F.lag("v").over(w), "f": F.lead("v").over(w)}), ["p", "f"])
    for desc in (False, True):
        o = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        same(R.percent_rank(df, keys, "v", "p", desc, **SMALL), df.withColumn("p", F.percent_rank().over(W.partitionBy(*keys).orderBy(o))), ["p"])


def test_hot_ties_are_cut_by_the_next_column(spark):
    """Nearly all rows share one day: the second order column cuts them."""
    rows = [(i, "g", datetime.datetime(2000, 1, 1 if i % 50 else 2), 1.0, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, day timestamp_ntz, v double, extra int")
    cut = R.with_ranges(df, [], ["day", "id"], rows=50, grid=31)
    sizes = [r["count"] for r in cut.groupBy(R.RANGE).count().collect()]
    assert max(sizes) < 300 and sum(sizes) == 2000
    ids = [r.id for r in cut.orderBy(R.RANGE, "day", "id").collect()]
    assert ids == [r.id for r in df.orderBy("day", "id").collect()]


def test_small_groups_stay_whole(spark):
    df = frame(spark, 60, seed=3).where("day IS NOT NULL")
    assert {r[R.RANGE] for r in R.with_ranges(df, ["g"], ["day"]).select(R.RANGE).collect()} == {1}


def test_largest_range_is_a_fair_share(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    cut = R.with_ranges(df, [], ["o_orderdate", "o_orderkey"], rows=100, grid=255)
    sizes = [r["count"] for r in cut.groupBy(R.RANGE).count().collect()]
    assert len(sizes) > 100 and max(sizes) <= 3 * sum(sizes) / 128


def test_interval_join(spark):
    """Against a nested loop: shared edges, zero and huge lengths, NULLs, ties, several widths."""
    from tidewater.operators.joins import interval_join
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", None]), None if r.random() < 0.05 else r.choice([0.0, 1.0, 2.5, -3.0]) + r.randrange(60)) for i in range(300)]
    bands = []
    for i in range(60):
        lo = r.randrange(60) - 5.0
        bands.append((i, r.choice(["a", "b", None]), lo, lo + r.choice([0.0, 0.25, 1.0, 3.0, 4.0, 1e6]), i))
    bands += [(100, "a", None, 4.0, 0), (101, "a", 3.0, None, 0), (102, "a", 5.0, 4.0, 0)]
    df = spark.createDataFrame(rows, "id long, g string, x double")
    b = spark.createDataFrame(bands, "band long, g string, lo double, hi double, extra int")
    want = {(i, k) for i, g, x in rows for k, h, lo, hi, _ in bands if g is not None and g == h and None not in (x, lo, hi) and lo <= x <= hi}
    got = [(q.id, q.band) for q in interval_join(df, "x", b, "lo", "hi", on=["g"]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = interval_join(df, "x", b, "lo", "hi", on=["g"], how="left")
    assert left.columns == ["id", "g", "x", "band", "lo", "hi", "extra"]
    none = {i for i, _, _ in rows} - {i for i, _ in want}
    assert sorted((q.id, q.band or -1) for q in left.collect()) == sorted([(i, k or -1) for i, k in want] + [(i, -1) for i in none])
    plan = interval_join(df, "x", b, "lo", "hi", on=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(df, "x", b.where("false"), "lo", "hi").collect() == []


@pytest.fixture()
def plain_joins(spark):
    """No join turns into a broadcast or is split at run time."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def in_one_partition(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_few_large_groups_are_not_brought_together(spark, plain_joins):
    """Three groups: no row moves to find its range, and no group ends in one task."""
    df = spark.range(6000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("g"), ((F.col("id") * 7) % 5000).cast("double").alias("v")).repartition(6)
    for order in (["v"], ["v", "id"]):
        cut = R.with_ranges(df, ["g"], order, **SMALL)
        assert "hashpartitioning(g" not in cut._jdf.queryExecution().executedPlan().toString()
        assert in_one_partition(cut) <= 1100
        assert cut.count() == 6000


def test_large_and_many_groups(spark, plain_joins):
    """One hot group and 1,100 that are just cut: the hot one's rows are dealt out, all ranks are right."""
    rows = [(i, "hot", None, None if i % 40 == 0 else float(i * 7 % 1900), 0) for i in range(4000)]
    rows += [(10_000 + 8 * g + k, None if g == 0 else f"g{g}", None, float((k * 5 + g) % 8 // (1 + g % 2)), k) for g in range(1100) for k in range(8)]
    df = spark.createDataFrame(rows, "id long, g string, day timestamp_ntz, v double, extra int").repartition(8)
    cut = R.with_ranges(df, ["g"], ["v", "id"], **SMALL)
    assert in_one_partition(cut) <= 3200 and cut.count() == len(rows)
    for desc in (False, True):
        o = F.col("v").desc_nulls_last() if desc else F.col("v").asc_nulls_first()
        same(R.percent_rank(df, ["g"], "v", "p", desc, **SMALL), df.withColumn("p", F.percent_rank().over(W.partitionBy("g").orderBy(o))), ["p"])
    w = W.partitionBy("g").orderBy("v", "id")
    same(R.running_total(df, ["g"], ["v", "id"], "extra", "t", **SMALL), df.withColumn("t", F.sum("extra").over(w.rowsBetween(W.unboundedPreceding, 0))), ["t"])
