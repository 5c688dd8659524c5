"""Reshaping: wide year-per-column sheets to long tables, column
selection by prefix or position, appending rows by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.text import digits_only


def cols_with_prefix(df: DataFrame, prefix: str, ignore_case: bool = True) -> list[str]:
    """tidyselect ``starts_with(prefix)`` (case-insensitive by default)."""
    if ignore_case:
        return [c for c in df.columns if c.lower().startswith(prefix.lower())]
    return [c for c in df.columns if c.startswith(prefix)]


def cols_by_position(df: DataFrame, first: int, last: int) -> list[str]:
    """R ``names(df)[first:last]`` (1-based, inclusive)."""
    return df.columns[first - 1:last]


def clean_long(df: DataFrame, value_cols: Sequence[str], value_name: str,
               names_to: str = "Year") -> DataFrame:
    """Wide → long (``pivot_longer``) with the year taken from the digits of
    the column name and the cell parsed as a number (NULL when it is not
    one, e.g. ``':'``).  Rows with missing cells are kept, as in R.

    The year must be exactly four digits; a header whose digits are longer
    (a footnote number glued to the year) gives a NULL year instead of a
    wrong one.  This is a per-row projection (``Expand``): no shuffle.
    """
    value_cols = list(value_cols)
    ids = [c for c in df.columns if c not in value_cols]
    s = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("string").alias(c) for c in value_cols])
    long = s.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in value_cols], names_to, "__cell")
    d = digits_only(F.col(names_to))
    year = F.when(F.length(d) == 4, d.cast("int"))
    value = F.expr("try_cast(`__cell` AS double)")
    return long.select(*[F.col(f"`{c}`") for c in ids], year.alias(names_to), value.alias(value_name))


def bind_rows(df: DataFrame, other: DataFrame) -> DataFrame:
    """``bind_rows``: append by column name, missing columns as NULL."""
    return df.unionByName(other, allowMissingColumns=True)
