from pyspark.sql import functions as F

from tidewater.sources.sheets import read_sheet, read_sheet_with_preamble
from tidewater.sources.sinks import write_datasets
from tidewater.sources.tables import Tables, publish_view


def test_preamble_sheet(spark, scratch):
    for k in range(2):
        with open(f"{scratch}/s{k}.csv", "w") as f:
            f.write("Title\nSubtitle\n")
            f.write("Code,Name,Year 2001\n")
            f.write(f'E{k},"A, b",:\n')
            f.write(f"F{k},C,12.5\n")
    df = read_sheet_with_preamble(spark, scratch, skip=2)
    assert df.columns == ["Code", "Name", "Year 2001"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("E0", "A, b", None), ("E1", "A, b", None), ("F0", "C", "12.5"), ("F1", "C", "12.5")]


def test_plain_sheet_and_sinks(spark, scratch):
    with open(f"{scratch}/plain.csv", "w") as f:
        f.write("Year,Net\n2001,10\n2002,:\n")
    df = read_sheet(spark, f"{scratch}/plain.csv", "Year int, Net double", null_value=":")
    assert sorted(tuple(r) for r in df.collect()) == [(2001, 10.0), (2002, None)]
    paths = write_datasets({"a": df, "b": df.withColumn("k", F.lit("x"))}, f"{scratch}/out",
                           partition_by={"b": ["k"]})
    assert spark.read.parquet(paths[0]).count() == 2
    assert spark.read.parquet(paths[1]).where("k = 'x'").count() == 2


def test_tables_and_view(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    v = publish_view(t.region, "tw_region")
    assert v.count() == spark.sql("select count(*) from tw_region").first()[0] == 5


def test_sheet_writer_roundtrip(spark, scratch):
    from tidewater.sources.sinks import write_sheet_with_preamble
    df = spark.createDataFrame([("E1", "A, b", 1.5), ("E2", "C", None)], "Code string, Name string, `Year 2001` double") \
        .repartition(2)
    path = write_sheet_with_preamble(df, f"{scratch}/sheet", ["Title", "Note"])
    back = read_sheet_with_preamble(spark, path, skip=2, na=":")
    assert back.columns == ["Code", "Name", "Year 2001"]
    assert sorted(tuple(r) for r in back.collect()) == [("E1", "A, b", "1.5"), ("E2", "C", None)]


def test_preamble_sheet_split_across_partitions(spark, scratch):
    # a file larger than the split size: only the split at byte 0 carries the preamble
    with open(f"{scratch}/big.csv", "w") as f:
        f.write("Title line\n")
        f.write("Code,Value\n")
        for i in range(3000):
            f.write(f"C{i:05d},{':' if i % 7 == 0 else i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = spark.read.text(scratch)
        assert raw.rdd.getNumPartitions() > 3
        df = read_sheet_with_preamble(spark, scratch, skip=1)
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 3000
    got = {r.Code: r.Value for r in rows}
    assert got["C00000"] is None and got["C00001"] == "1" and got["C02999"] == "2999"


def test_parquet_schema_cache_follows_rewrites(spark, scratch):
    """The cached schema is keyed on the path's modification time: a table
    rewritten with another schema is read with the new one."""
    import os
    import time
    from tidewater.sources.tables import read_parquet
    path = os.path.join(scratch, "t.parquet")
    spark.createDataFrame([(1, "a")], "k int, s string").write.parquet(path)
    assert read_parquet(spark, path).columns == ["k", "s"]
    assert read_parquet(spark, path).collect()[0].s == "a"
    time.sleep(1.1)  # coarse file-system clocks
    spark.createDataFrame([(2.5,)], "x double").write.mode("overwrite").parquet(path)
    back = read_parquet(spark, path)
    assert back.columns == ["x"] and back.collect()[0].x == 2.5
