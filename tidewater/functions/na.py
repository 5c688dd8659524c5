"""Missing-value algebra of the source analyses, expressed with built-ins.

The R scripts let NA propagate through ``sum``/``cumsum``/``median``
unless ``na.rm = TRUE``, keep NA rows under ``!x %in% list``, sort NA last
in both directions and produce Inf/NaN on division by zero.  Spark skips
NULL in aggregates, drops NULL rows under ``NOT IN`` and raises on
division by zero under ANSI mode.  These helpers bridge the two without
leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F
from pyspark.sql.window import WindowSpec


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_div(num, den) -> Column:
    """Division that yields NULL on a zero or NULL divisor (R: Inf/NaN)."""
    return F.try_divide(col(num), col(den))


def pct_change(cur, prev) -> Column:
    """``(cur - prev) / prev * 100`` with NULL for a zero/NULL base."""
    return try_div(col(cur) - col(prev), col(prev)) * F.lit(100.0)


def not_in_keep_null(c, values: Iterable) -> Column:
    """R ``!x %in% values``: NULL x is *kept* (``%in%`` never yields NA)."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def in_list(c, values: Iterable) -> Column:
    """R ``x %in% values``: NULL x is dropped."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def sum_strict(c) -> Column:
    """Aggregate ``sum(x)`` without ``na.rm``: NULL if any input is NULL."""
    return F.when(F.count_if(col(c).isNull()) == 0, F.sum(col(c)))


def r_round(c, digits: int = 0) -> Column:
    """R ``round``: half to even."""
    return F.bround(col(c), digits)


def asc_last(c) -> Column:
    """R ``arrange(x)``: NA last."""
    return col(c).asc_nulls_last()


def desc_last(c) -> Column:
    """R ``arrange(desc(x))``: NA last."""
    return col(c).desc_nulls_last()


def ln_positive(c) -> Column:
    """Log-scale value: ``ln(x)`` for ``x > 0``, else NULL."""
    return F.when(col(c) > 0, F.ln(col(c)))


def clip(c, lo, hi) -> Column:
    """Axis limits blank out values outside ``[lo, hi]`` (ggplot ``limits``)."""
    return F.when(col(c).between(lo, hi), col(c))
