"""Base-table scans (A1) and published views (A6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables the driver provides, one parquet file (or folder) each.
DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """``spark.read.parquet(path)``: the schema as it is now."""
    return spark.read.parquet(path)


class Tables:
    """Lazy accessor for ``<root>/<name>.parquet`` tables.

    Each access is a plain Parquet read, so Catalyst prunes columns and
    pushes filters into the scan of every query that uses it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return read_parquet(self.spark, self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self(name)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return Tables(spark, root)(name)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """``CREATE OR ALTER VIEW`` counterpart: a session temp view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def store_view(spark: SparkSession, name: str, select: str, **paths: str) -> None:
    """``CREATE OR ALTER VIEW`` in the catalogue: the view outlives the session
    that made it and is replaced in one step.  ``select`` names tables as
    ``{table}``; each is a Parquet path, so that nothing session-bound is used."""
    relations = {t: "parquet.`" + p.replace("`", "``") + "`" for t, p in paths.items()}
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {select.format(**relations)}")
