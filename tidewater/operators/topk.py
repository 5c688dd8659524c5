"""Sorted limits, top-k with a remainder row, arg-min / arg-max."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_n(df: DataFrame, value: str, n: int, tie_break: Sequence[str], descending: bool = True) -> DataFrame:
    """R ``arrange([desc](x)) %>% head(n)`` with NAs last and a deterministic
    tie-break.  Planned as ``TakeOrderedAndProject``: each partition keeps
    its own top ``n`` and only those reach the final merge."""
    key = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return df.orderBy(key, *[F.col(c).asc_nulls_last() for c in tie_break]).limit(n)


def top_n_per_group(df: DataFrame, groups: Sequence[str], value: str, n: int, tie_break: Sequence[str],
                    descending: bool = True, rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per group with a 1-based rank column.  Spark plans a
    group-limit (``WindowGroupLimit``) before the shuffle, so each group
    moves at most ``n`` rows per partition."""
    key = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    w = W.partitionBy(*groups).orderBy(key, *[F.col(c).asc_nulls_last() for c in tie_break])
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def arg_extreme(label: str, value: str, largest: bool = False) -> Column:
    """Aggregate: the ``label`` of the row with the smallest (largest)
    ``value``; NULL values ignored, ties go to the smallest label, an
    all-NULL group gives NULL (R ``name[which.min(x)]`` with a
    deterministic tie rule)."""
    v = F.col(value)
    key = F.struct((-v if largest else v).alias("k"), F.col(label).alias("l"))
    return F.min_by(F.col(label), F.when(v.isNotNull(), key))


def with_remainder(top: DataFrame, entity: str, value: str, total: DataFrame, rest_label: str) -> DataFrame:
    """Append one row ``(rest_label, total - sum(top values))``.

    ``total`` is a one-row frame with column ``total`` (an aggregate, so it
    has one row even when the total is missing; the remainder is then
    NULL).  R's ``sum`` without ``na.rm`` makes the remainder NULL when a
    top value is NULL.
    """
    s = top.agg(F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(value)).alias("__s"))
    rest = s.crossJoin(F.broadcast(total)).select(   # one row x one row
        F.lit(rest_label).alias(entity), (F.col("total") - F.col("__s")).alias(value))
    return top.unionByName(rest, allowMissingColumns=True)
