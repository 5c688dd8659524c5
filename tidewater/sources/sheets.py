"""Sheet and boundary readers (A2, A3, A4).

Spreadsheets are exported one file per sheet.  ``read_sheet`` reads a
CSV or Parquet export with an explicit schema.  ``read_sheet_with_preamble``
handles exports that carry N title lines before the header and a missing
marker such as ``':'``, whose quoted cells may hold line ends:

1. files are read as lines, in parallel splits.  A first pass counts lines and
   quotes of every split; whether a split begins inside a quoted cell follows from
   the quotes before it in its file (an odd number: yes).
2. the second pass joins the lines of each split to records.  A record that
   a split's end cuts leaves pieces, one a split, which are put together again.
3. records are parsed once, by position, and every file's header says which
   column a position is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "csv", header: bool = True, null_value: str | None = None) -> DataFrame:
    """One exported sheet with an explicit schema (no inference)."""
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", header)
        if null_value is not None:
            r = r.option("nullValue", null_value)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


# quotes inside a quoted cell are doubled, and cells are kept as they stand
CSV = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_PIECE = "file string, start bigint, kind string, value string"


def _splits_of(batches):
    """``(file, start, [lines])`` in file order; a split may come in parts."""
    for pdf in batches:
        same = (pdf["file"] != pdf["file"].shift()) | (pdf["start"] != pdf["start"].shift())
        for _, g in pdf.groupby(same.cumsum(), sort=False):
            yield g["file"].iloc[0], int(g["start"].iloc[0]), g["value"].tolist()


def _split_facts(skip: int):
    """mapInPandas body: ``(file, start, n, odd, first)``: lines, whether their
    quotes are odd in number, and the same for each of the first ``skip``."""
    def run(batches):
        import pandas as pd
        facts: dict[tuple, list] = {}
        for file, start, lines in _splits_of(batches):
            f = facts.setdefault((file, start), [0, 0, []])
            for line in lines:
                odd = line.count('"') % 2
                f[0] += 1
                f[1] ^= odd
                if len(f[2]) < skip:
                    f[2].append(odd)
        yield pd.DataFrame([(*k, *v) for k, v in facts.items()], columns=["file", "start", "n", "odd", "first"])
    return run


def _records(skip: int, entry: dict[tuple[str, int], tuple[int, int]]):
    """mapInPandas body: records of each split.  Kinds: ``h`` header, ``d``
    data; of a record that goes beyond the split, ``ho``/``do`` its beginning,
    ``m`` a whole split inside it, ``c`` its end.  ``entry`` holds (lines
    before, inside a cell) of splits that begin inside a cell or no later than
    the header; others begin with a record."""
    def run(batches):
        import pandas as pd
        out: list[tuple] = []
        at, kind, inside, held, line_no = None, "", 0, [], 0

        def flush(end: bool):
            nonlocal held
            text = "\n".join(held)
            if end:
                out.append((*at, kind, text))
            elif held:
                out.append((*at, "m" if kind == "c" else kind + "o", text))
            held = []

        for file, start, lines in _splits_of(batches):
            if (file, start) != at:
                if at:
                    flush(False)
                at = (file, start)
                line_no, inside = (0, 0) if start == 0 else entry.get(at, (skip + 1, 0))
                kind = "c" if inside else ""
            for line in lines:
                line_no += 1
                if line_no <= skip and not inside:
                    continue
                if not held and not inside:
                    kind = "h" if line_no == skip + 1 else "d"
                held.append(line)
                inside ^= line.count('"') % 2
                if not inside:
                    held[-1] = held[-1].removesuffix("\r")
                    if kind != "d" or len(held) > 1 or held[0]:
                        flush(True)
                    held = []
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=["file", "start", "kind", "value"])
                out = []
        if at:
            flush(False)
        yield pd.DataFrame(out, columns=["file", "start", "kind", "value"])
    return run


def sheet_records(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """``(file, kind, value)``: the header (``h``) and data (``d``) records of
    every file after its first ``skip`` lines; a record may span lines."""
    raw = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    facts = raw.mapInPandas(_split_facts(skip), "file string, start bigint, n bigint, odd int, first array<int>")
    w = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)    # the splits of a file
    facts = facts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    title = F.slice("first", 1, F.greatest(F.lit(0), F.lit(skip) - F.col("before")).cast("int"))     # its preamble lines do not count
    facts = facts.withColumn("odd", F.col("odd") + F.aggregate(title, F.lit(0), lambda a, x: a + x))
    facts = facts.withColumn("inside", F.coalesce(F.sum("odd").over(w), F.lit(0)) % 2)
    # splits that do not simply begin with a data record
    some = facts.where((F.col("start") > 0) & ((F.col("inside") == 1) | (F.col("before") <= skip))).select("file", "start", "before", "inside").collect()
    entry = {(r.file, r.start): (r.before, int(r.inside)) for r in some}
    pieces = raw.mapInPandas(_records(skip, entry), _PIECE)
    whole = pieces.where(F.col("kind").isin("h", "d")).select("file", "kind", "value")
    # at most two pieces a split; a record is its beginning and what follows up to the next beginning
    cut = pieces.where(~F.col("kind").isin("h", "d")).withColumn("begins", F.col("kind").endswith("o").cast("int"))
    order = W.partitionBy("file").orderBy("start", "begins")
    cut = cut.withColumn("record", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = cut.groupBy("file", "record").agg(
        F.max(F.when(F.col("begins") == 1, F.substring("kind", 1, 1))).alias("kind"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "begins", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return whole.unionByName(joined.select("file", "kind", "value"))


def _header(record: str) -> list[str]:
    """Column names; a repeated one gets its position."""
    import csv
    names = next(csv.reader([record.replace("\n", "\x00")]), [])
    names = [n.replace("\x00", "\n") for n in names]
    return [n if n not in names[:k] else f"{n}...{k + 1}" for k, n in enumerate(names)]


def read_sheet_with_preamble(spark: SparkSession, path: str, skip: int = 1, na: str | None = ":",
                             columns: Sequence[str] | None = None) -> DataFrame:
    """``read_excel(path, skip=N, na=":")`` for CSV exports: drop the first
    ``skip`` lines of every file, take the next record as the header, read all
    cells as text with ``na`` as NULL.  Quoted cells may hold commas, doubled
    quotes and line ends.

    Without ``columns`` every file is read by its own header, columns matched by
    name; any number of layouts is parsed in one pass.
    """
    records = sheet_records(spark, path, skip)
    body = records.where(F.col("kind") == "d")
    place = None
    if columns is not None:
        columns, wide = list(columns), len(columns)
    else:
        heads = records.where(F.col("kind") == "h").select("file", F.col("value").alias("header"))
        # the sheet's columns: one row a distinct header
        layouts = [(r.header, _header(r.header)) for r in heads.groupBy("header").agg(F.min("file").alias("f")).orderBy("f").collect()]
        if not layouts:
            raise ValueError(f"{path}: no header after {skip} preamble lines")
        columns = list(dict.fromkeys(c for _, names in layouts for c in names))
        wide = max(len(names) for _, names in layouts)
        if len(layouts) > 1:
            at = [(h, [names.index(c) if c in names else -1 for c in columns]) for h, names in layouts]
            place = heads.join(spark.createDataFrame(at, "header string, at array<int>"), "header").select("file", "at")
    ddl = ", ".join(f"c{k} STRING" for k in range(wide))
    cells = F.from_csv("value", F.lit(ddl), {**CSV, **({"nullValue": na} if na is not None else {})})
    if place is None:
        out = body.select(cells.alias("__r")).select(*[F.col(f"__r.c{k}").alias(c) for k, c in enumerate(columns)])
    else:
        row = body.join(place, "file").select(cells.alias("__r"), "at").select(F.array(*[F.col(f"__r.c{k}") for k in range(wide)]).alias("__c"), "at")
        out = row.select(*[F.get("__c", F.col("at")[k]).alias(c) for k, c in enumerate(columns)])
    if na is not None:
        out = out.select(*[F.when(F.trim(F.col(f"`{c}`")) == na, None).otherwise(F.col(f"`{c}`")).alias(c)
                           for c in columns])
    return out


def read_boundary(spark: SparkSession, path: str, code_col: str, geom_col: str = "geom") -> DataFrame:
    """Boundary table exported to Parquet: a code and a geometry (WKB or
    WKT) passed through untouched; only attribute joins use it."""
    return spark.read.parquet(path).select(code_col, geom_col)
