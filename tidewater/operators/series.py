"""Entity-by-period series operators (lag change, running totals, stacks).

These run on panels: one row per (entity, period), sized by the number of
entities and periods rather than by the fact data they were aggregated
from, so per-entity windows hold a handful of rows each.  Series of raw rows,
where one entity may hold any share of them, go through ``operators.ranges``
(``running_total``, ``neighbours``, ``local_extrema``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.functions.na import pct_change


def _keys(k: str | Sequence[str]) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def lag_pct_change(df: DataFrame, entity: str | Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """``(x - lag(x)) / lag(x) * 100`` within each entity ordered by
    ``order``: the previous *row*, NULL for the first row and for a zero or
    NULL base."""
    w = W.partitionBy(*_keys(entity)).orderBy(order)
    return df.withColumn(out, pct_change(F.col(value), F.lag(value).over(w)))


def lag_change(df: DataFrame, entity: str | Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """``x - lag(x)`` within each entity ordered by ``order``."""
    w = W.partitionBy(*_keys(entity)).orderBy(order)
    return df.withColumn(out, F.col(value) - F.lag(value).over(w))


def running_total(df: DataFrame, entity: str | Sequence[str], order: str, value: str, out: str,
                  strict: bool = True) -> DataFrame:
    """Cumulative sum per entity.  ``strict`` (R ``cumsum``): NULL from the
    first NULL on; otherwise NULLs are skipped."""
    w = W.partitionBy(*_keys(entity)).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    s = F.sum(value).over(w)
    if strict:
        s = F.when(~F.bool_or(F.col(value).isNull()).over(w), s)
    return df.withColumn(out, s)


def stack_bounds(df: DataFrame, period: str, ordinal: str | Sequence[str], value: str,
                 lower: str = "stack_lower", upper: str = "stack_upper") -> DataFrame:
    """Stacked-area bounds: within each period, entities stacked in
    ``ordinal`` order; upper = running sum, lower = upper - value."""
    w = W.partitionBy(period).orderBy(*_keys(ordinal)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(upper, F.sum(value).over(w)).withColumn(lower, F.col(upper) - F.col(value))
