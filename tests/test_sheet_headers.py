"""Sheets whose files order their columns differently."""

from tidewater.sources.sheets import read_boundary, read_sheet_with_preamble


def test_each_file_by_its_own_header(spark, scratch):
    for name, text in (("a.csv", "Title\nCode,Val\nA,1\nC,:\n"), ("b.csv", "Title\nVal,Code\n2,B\n"), ("c.csv", "Other\nCode,More\nD,x\n")):
        with open(f"{scratch}/{name}", "w") as f:
            f.write(text)
    got = read_sheet_with_preamble(spark, scratch, skip=1)
    assert got.columns == ["Code", "Val", "More"]
    assert sorted(map(tuple, got.collect())) == [("A", "1", None), ("B", "2", None), ("C", None, None), ("D", None, "x")]


def test_boundary_reads_code_and_geometry(spark, scratch):
    spark.createDataFrame([("A", "POINT (0 0)", 1)], "code string, geom string, extra int").write.parquet(f"{scratch}/b")
    got = read_boundary(spark, f"{scratch}/b", "code")
    assert got.columns == ["code", "geom"] and got.first().geom == "POINT (0 0)"
