"""Helpers shared by the operators: table reads, row keys, cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared checkpoint
    folder and read it again.  A file has its true size for the planner, where
    a chain of checkpoints would multiply its estimates with every join.  The
    table is deleted when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text)`` only: other columns, whatever their names, stay out
    of an operator's way.  A null text counts as an empty one."""
    return df.select(F.col(id_col).alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
