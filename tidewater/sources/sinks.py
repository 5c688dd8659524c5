"""Dataset sinks (A5): one dataset per named table, partitioned by a key
when asked (facets, years); several tables published as one set."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.sources.sheets import CSV

_MANIFEST = "version bigint, folder string, name string, format string"


def write_datasets(tables: Mapping[str, DataFrame], out: str, mode: str = "overwrite",
                   fmt: str = "parquet", partition_by: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """``write_xlsx(list(a = df1, b = df2), path)`` counterpart: each named
    table becomes ``<out>/<name>`` in ``fmt``.  Returns the written paths."""
    paths = []
    for name, df in tables.items():
        w = df.write.mode(mode).format(fmt)
        keys = (partition_by or {}).get(name)
        if keys:
            w = w.partitionBy(*keys)
        p = f"{out.rstrip('/')}/{name}"
        w.save(p)
        paths.append(p)
    return paths


def _manifest(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).json(f"{out.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def publish_datasets(tables: Mapping[str, DataFrame], out: str, fmt: str = "parquet",
                     partition_by: Mapping[str, Sequence[str]] | None = None) -> int:
    """Publish several tables as one set: all of them are staged in a folder of
    their own, and one manifest file, written last, makes them the current
    set.  Readers (``read_published``) see the old set until then, and go on
    seeing it if anything fails.  Returns the set's version."""
    out, folder = out.rstrip("/"), uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    write_datasets(tables, f"{out}/sets/{folder}", mode="errorifexists", fmt=fmt, partition_by=partition_by)
    before = _manifest(spark, out)
    version = 1 + ((before.agg(F.max("version")).first()[0] or 0) if before is not None else 0)
    rows = spark.createDataFrame([(version, folder, name, fmt) for name in tables], _MANIFEST)
    rows.coalesce(1).write.mode("append").json(f"{out}/manifest")      # one file, renamed into place
    return version


def read_published(spark: SparkSession, out: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the current published set, or of an earlier version.  Of two
    sets published at once with the same version one is the current one."""
    m = _manifest(spark, out)
    rows = [] if m is None else m.where(F.lit(version is None) | (F.col("version") == F.lit(version))) \
        .groupBy("version", "folder").agg(F.max(F.when(F.col("name") == name, F.col("format"))).alias("format")) \
        .orderBy(F.desc("version"), F.desc("folder")).limit(1).where("format IS NOT NULL").collect()
    if not rows:
        raise KeyError(f"no published table {name!r} in {out}")
    return spark.read.format(rows[0]["format"]).load(f"{out.rstrip('/')}/sets/{rows[0].folder}/{name}")


def _csv_line(values) -> str:
    import csv
    import io
    buf = io.StringIO()
    csv.writer(buf, lineterminator="").writerow(values)
    return buf.getvalue()


def write_sheet_with_preamble(df: DataFrame, path: str, preamble: Sequence[str] = (), na: str = ":",
                              mode: str = "overwrite") -> str:
    """Write ``df`` as CSV text files that each start with the ``preamble``
    lines and the header (the layout of a published sheet), NULL as ``na``.

    Cells with commas, quotes or line ends are quoted, quotes doubled, so
    ``read_sheet_with_preamble`` reads them back as they are.
    Rows are formatted with ``to_csv`` in the JVM; a ``mapInPandas`` pass
    puts the preamble and header in front of each partition's lines, so
    every output file is a complete sheet and no task sees more than its
    own partition.
    """
    header = _csv_line(df.columns)
    head = list(preamble) + [header]
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(na)).alias(c) for c in df.columns]
    lines = df.select(F.to_csv(F.struct(*cells), {**CSV, "emptyValue": ""}).alias("value"))

    def prepend(batches):
        import pandas as pd
        from pyspark import TaskContext
        started = TaskContext.get().partitionId() == 0      # a sheet without rows has a header too
        if started:
            yield pd.DataFrame({"value": head})
        for pdf in batches:
            if not started and len(pdf):
                started = True
                yield pd.DataFrame({"value": head})
            yield pdf

    lines.mapInPandas(prepend, "value string").write.mode(mode).text(path)
    return path
