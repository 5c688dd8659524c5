"""Fixed-break binning (H16) and band tables (K1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewater.functions.na import col


def fixed_bins(c, breaks: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Bin index (0-based) for ``breaks``: left-closed intervals, the last
    one also right-closed; values outside or NULL give NULL.  With
    ``labels`` the label of the bin is returned instead."""
    x = col(c)
    b = list(breaks)
    if len(b) < 2:
        raise ValueError("need at least two breaks")
    expr = None
    for i in range(len(b) - 1):
        last = i == len(b) - 2
        cond = (x >= b[i]) & ((x <= b[i + 1]) if last else (x < b[i + 1]))
        val = F.lit(labels[i] if labels else i)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def bin_labels(breaks: Sequence[float]) -> list[str]:
    def f(v):
        return str(int(v)) if float(v).is_integer() else str(v)
    return [f"[{f(breaks[i])},{f(breaks[i + 1])}" + ("]" if i == len(breaks) - 2 else ")")
            for i in range(len(breaks) - 1)]


def bands_frame(spark: SparkSession, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Band definitions (name, lo, hi) as a DataFrame; the rows are the
    caller's parameters, bounded by their count."""
    schema = T.StructType([
        T.StructField("band", T.StringType(), False),
        T.StructField("band_lo", T.DoubleType(), False),
        T.StructField("band_hi", T.DoubleType(), False),
    ])
    return spark.createDataFrame([(n, float(lo), float(hi)) for n, lo, hi in bands], schema)
