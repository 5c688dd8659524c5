"""Sheets whose quoted cells hold line ends, cut by splits anywhere; sets of
tables published together; stored views."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.sources.sheets import read_sheet_with_preamble
from tidewater.sources.sinks import publish_datasets, read_published, write_sheet_with_preamble
from tidewater.sources.tables import store_view


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_two_cells(spark, scratch):
    df = spark.createDataFrame([("1", "a\nb"), ("2", "c")], "k string, v string")
    path = write_sheet_with_preamble(df, f"{scratch}/s", ["Title"])
    assert sorted(map(tuple, read_sheet_with_preamble(spark, path).collect())) == [("1", "a\nb"), ("2", "c")]


def test_round_trip_over_splits(spark, scratch, small_splits):
    r = random.Random(3)
    parts = ["x", "\n", "\"", ",", "\n\n", "é", " ", "long text " * 9, "\r\n", "\\", "'"]
    rows = [(f"{i:03d}", "".join(r.choice(parts) for _ in range(r.randrange(1, 12))) + ".", str(i)) for i in range(60)]
    rows += [("900", "line\n" * 60 + "end", None), ("901", None, ":x")]
    df = spark.createDataFrame(rows, 'k string, `cell\nwith "ends"` string, n string').repartition(2)
    path = write_sheet_with_preamble(df, f"{scratch}/s", ['A "title', "with, odd quotes\""])
    got = read_sheet_with_preamble(spark, path, skip=2)
    assert got.columns == ["k", 'cell\nwith "ends"', "n"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(rows, key=str)


def test_windows_line_ends_and_open_end(spark, scratch, small_splits):
    with open(f"{scratch}/a.csv", "w", newline="") as f:
        f.write('Title\r\nCode,Note\r\nA,"one\r\ntwo"\r\n\r\nB,plain\r\nC,"never closed\nmore')
    got = read_sheet_with_preamble(spark, scratch, skip=1)
    assert sorted(x.Code for x in got.collect()) == ["A", "B", "C"]
    assert {x.Code: x.Note for x in got.collect()}["A"] == "one\r\ntwo" and {x.Code: x.Note for x in got.collect()}["B"] == "plain"


def test_many_layouts(spark, scratch):
    """Every file has a header of its own; one pass reads them all."""
    for k in range(60):
        with open(f"{scratch}/f{k:02d}.csv", "w") as f:
            names = ["Code", f"V{k % 57}", "W"]
            f.write("T\n" + ",".join(names[::-1] if k % 2 else names) + "\n")
            f.write(f"w{k},{k},c{k}\n" if k % 2 else f"c{k},{k},w{k}\n")
    got = read_sheet_with_preamble(spark, scratch)
    assert len(got.columns) == 59 and got.count() == 60
    for x in got.collect():
        k = int(x.Code[1:])
        assert x[f"V{k % 57}"] == str(k) and x.W == f"w{k}" and sum(v is not None for v in x) == 3


def test_sheet_without_rows(spark, scratch):
    path = write_sheet_with_preamble(spark.createDataFrame([], "a string, b int"), f"{scratch}/s", ["T"])
    back = read_sheet_with_preamble(spark, path)
    assert back.columns == ["a", "b"] and back.collect() == []


def test_published_set_survives_a_failure(spark, scratch):
    one, two = spark.range(3).withColumn("v", F.lit("old")), spark.range(2).withColumn("v", F.lit("old"))
    assert publish_datasets({"a": one, "b": two}, scratch) == 1
    new = one.withColumn("v", F.lit("new"))
    broken = two.withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        publish_datasets({"a": new, "b": broken}, scratch)
    assert {r.v for r in read_published(spark, scratch, "a").collect()} == {"old"} and read_published(spark, scratch, "b").count() == 2
    assert publish_datasets({"a": new, "c": two}, scratch) == 2
    assert {r.v for r in read_published(spark, scratch, "a").collect()} == {"new"}
    assert {r.v for r in read_published(spark, scratch, "a", version=1).collect()} == {"old"}
    for name in ("b", "d"):
        with pytest.raises(KeyError):
            read_published(spark, scratch, name)
    with pytest.raises(KeyError):
        read_published(spark, f"{scratch}/nowhere", "a")


def test_stored_view_is_replaced(spark, scratch):
    spark.range(3).write.parquet(f"{scratch}/t")
    store_view(spark, "tw_stored", "SELECT count(*) AS n FROM {t}", t=f"{scratch}/t")
    assert spark.newSession().table("tw_stored").first().n == 3
    store_view(spark, "tw_stored", "SELECT max(id) AS m FROM {t}", t=f"{scratch}/t")
    assert spark.newSession().sql("SELECT * FROM tw_stored").first().m == 2
    spark.sql("DROP VIEW tw_stored")
