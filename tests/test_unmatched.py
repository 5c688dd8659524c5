"""NULL and unmatched keys, exact cutoffs, changed schemas."""

import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.operators import order_stats as O
from tidewater.plans import sheets as SH
from tidewater.plans import star as S
from tidewater.sources.tables import read_parquet


def test_null_customer_has_percent_ranks(spark):
    df = spark.createDataFrame([(1, 5.0), (None, 3.0), (2, 9.0)], "customer_id long, recency double")
    got = {r.customer_id: r.r for r in O.exact_percent_ranks(df, {"recency": ("r", False)}).collect()}
    want = {r.customer_id: r.r for r in df.select("customer_id", F.percent_rank().over(W.orderBy("recency")).alias("r")).collect()}
    assert got == want


@pytest.mark.parametrize("descending", [False, True])
def test_cutoffs_without_exact_binary_form(spark, descending):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "k long, m double")
    cutoffs = [0.29, 0.57, 0.58, 0.25]
    t = O.percent_rank_thresholds(df, {"m": descending}, cutoffs)
    j = df.crossJoin(F.broadcast(t.select(*[F.col(c).alias(f"p_{c}") for c in t.columns if c != "measure"])))
    got = {r.k: tuple(r)[1:] for r in j.select("k", *[O.above_cutoff(F.col("m"), "p_", i, descending).alias(f"a{i}") for i in range(4)]).collect()}
    rank = F.percent_rank().over(W.orderBy(F.desc("m") if descending else F.col("m")))
    want = {r.k: tuple(r.pr > q for q in cutoffs) for r in df.select("k", rank.alias("pr")).collect()}
    assert got == want


def star(spark):
    day = dt.datetime(1995, 5, 1)
    return SH.Star(
        orders=spark.createDataFrame([(1, 1, "F", 10.0, day), (2, 9, "F", 20.0, day), (3, 1, "O", 5.0, None)],
                                     "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"),
        lineitem=None, supplier=None,
        customer=spark.createDataFrame([(1, 0), (9, None)], "c_custkey long, c_nationkey int"),
        nation=spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        region=spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"))


def test_null_year_and_unknown_nation_stay(spark):
    rows = {(r.entity, r.year): r.amount for r in SH.order_totals(star(spark)).collect() if r.entity in ("N", "World")}
    assert rows == {("N", 1995): 10.0, ("World", 1995): 30.0, ("N", None): 5.0, ("World", None): 5.0}


def test_unknown_customer_stays_in_sales(spark):
    s = star(spark)
    got = {r.region: r.total_sales for r in S.sales_by_region(s.orders, s.customer, s.nation, s.region).collect()}
    assert got == {"R": 15.0, None: 20.0}


def test_observed_medians_are_never_withheld_by_number(spark):
    cells = {(r.level, r.year): r.cell for r in SH.sheet_cells(star(spark), SH.WideSpec(), ("price",)).collect()}
    assert cells["n", 1995] == "10.0"


def test_columns_follow_the_years_of_the_cells(spark):
    cells = spark.createDataFrame([("n", "NAT0", 1990, "1.0"), ("n", "NAT0", None, "2.0"), ("n", "NAT0", 1996, "3.0")], "level string, code string, year int, cell string")
    got = SH._pivot(cells, ["code"], SH.WideSpec(), "Year {y}")
    assert got.columns == ["code", "Year 1990", *(f"Year {y}" for y in range(1995, 2002)), "Year NA"]
    assert got.first()["Year 1990"] == "1.0" and got.first()["Year NA"] == "2.0" and got.first()["Year 1995"] is None
    from tidewater.plans import affordability as A
    long = {r.Year: r[A.PRICE] for r in A.clean_long(got, got.columns[1:], A.PRICE).collect()}
    assert long[None] == 2.0 and long[1990] == 1.0 and long[1996] == 3.0


def test_unknown_customers_count_in_the_world(spark):
    """An order of a customer that no table knows, and one of a nation that no
    table knows, stay in the world's totals and medians."""
    s = star(spark)
    day = dt.datetime(1995, 6, 1)
    more = spark.createDataFrame([(4, 777, "F", 1e6, day), (5, 50, "F", 30.0, day)], s.orders.schema)
    s = SH.Star(**{**s.__dict__, "orders": s.orders.union(more), "customer": s.customer.union(spark.createDataFrame([(50, 99)], s.customer.schema))})
    rows = {(r.entity, r.year): r.amount for r in SH.order_totals(s).collect()}
    assert rows["World", 1995] == 1_000_060.0 and rows["N", 1995] == 10.0 and rows["R", 1995] == 10.0
    assert [r for r in rows if r[0] is None] == [(None, 1995)] and rows[None, 1995] == 1_000_050.0
    cells = {(r.level, r.year): (r["median"], r.n_obs) for r in SH.sheet_cells(s, SH.WideSpec(), ("price",)).collect()}
    assert cells["w", 1995] == (25.0, 4) and cells["n", 1995] == (10.0, 1)


def test_new_column_in_a_partition_is_seen(spark, scratch):
    path = f"{scratch}/t"
    spark.createDataFrame([(1, 0)], "k int, p int").write.partitionBy("p").parquet(path)
    assert read_parquet(spark, path).columns == ["k", "p"]
    spark.createDataFrame([(2, 5)], "k int, extra int").write.parquet(f"{path}/p=1")
    plain = spark.read.option("mergeSchema", "true").parquet(path).columns
    assert "extra" in plain and set(read_parquet(spark, path).columns) == set(spark.read.parquet(path).columns)
