"""Facts laid out by key: no exchange below their join, and a new layout for new data."""

import re

import pytest

from tidewater.catalog import load_all, QUERIES
from tidewater.sources.layout import clustered

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # facts are not this small elsewhere
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_join_without_exchange(spark, no_broadcast):
    load_all()
    p = plan(QUERIES["clustered_order_features"](spark, SF))
    assert "Join" in p and not re.search(r"Exchange|ShuffleQueryStage|BroadcastQueryStage", p)
    lines = plan(QUERIES["clustered_panel_lines"](spark, SF))
    plain = plan(QUERIES["panel_sheet_lines"](spark, SF))
    assert lines.count("Exchange hashpartitioning(l_orderkey") == 0 == lines.count("Exchange hashpartitioning(o_orderkey")
    assert plain.count("hashpartitioning(l_orderkey") > 0


def test_layout_follows_the_data(spark, scratch):
    path = f"{scratch}/t"
    spark.range(50).withColumnRenamed("id", "k").write.parquet(path)
    one = clustered(spark, path, "k", 4)
    assert one.count() == 50 and clustered(spark, path, "k", 4).inputFiles() == one.inputFiles() and len(one.inputFiles()) == 4
    spark.range(70).withColumnRenamed("id", "k").write.mode("overwrite").parquet(path)
    assert clustered(spark, path, "k", 4).count() == 70
    assert clustered(spark.newSession(), path, "k", 4).count() == 70


def test_layout_holds_the_columns_asked_for(spark, scratch):
    path = f"{scratch}/t"
    spark.range(50).selectExpr("id % 7 AS k", "id AS a", "id * 2 AS b", "CAST(id AS STRING) AS c").write.parquet(path)
    part = clustered(spark, path, "k", 4, columns=["b", "a"])
    assert sorted(part.columns) == ["a", "b", "k"] == sorted(spark.read.parquet(*part.inputFiles()).columns)
    assert sorted(map(tuple, part.select("k", "a", "b").collect())) == sorted((i % 7, i, i * 2) for i in range(50))
    assert clustered(spark, path, "k", 4, columns=["a", "b"]).inputFiles() == part.inputFiles()
    whole = clustered(spark, path, "k", 4)
    assert sorted(whole.columns) == ["a", "b", "c", "k"] and whole.inputFiles() != part.inputFiles()


def test_queries_lay_out_what_they_read(spark):
    """Columns that no step of a query reads are neither shuffled nor written."""
    load_all()
    for name, most in (("clustered_panel_lines", {"l_extendedprice", "l_discount", "l_tax", "o_custkey", "o_orderdate"}),
                       ("clustered_order_features", {"l_quantity", "l_discount", "l_tax", "l_extendedprice", "o_totalprice"})):
        files = [f for f in QUERIES[name](spark, SF).inputFiles() if "/clustered_" in f]
        laid = {c for f in files for c in spark.read.parquet(f).columns}
        assert files and laid == {"l_orderkey", "o_orderkey", *most}
