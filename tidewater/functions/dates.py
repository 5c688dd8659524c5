"""Date helpers with T-SQL semantics (H1-H4, B14)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

from tidewater.functions.na import col


def to_day(c) -> Column:
    """``CAST(ts AS date)``."""
    return F.to_date(col(c))


def day_diff(start, end) -> Column:
    """T-SQL ``DATEDIFF(day, start, end)`` (Spark's argument order is
    reversed): whole day boundaries from ``start`` to ``end``."""
    return F.datediff(F.to_date(col(end)), F.to_date(col(start)))


def add_years(c, years: int) -> Column:
    """T-SQL ``DATEADD(year, n, ts)``: keeps the time of day, 29 Feb is
    clamped to 28 Feb in non-leap target years."""
    if years == 0:
        return col(c)
    return col(c) + F.make_ym_interval(F.lit(years), F.lit(0))


def _parse(v) -> _dt.datetime:
    if isinstance(v, _dt.datetime):
        return v
    if isinstance(v, _dt.date):
        return _dt.datetime(v.year, v.month, v.day)
    return _dt.datetime.fromisoformat(str(v))


def ts_lit(v) -> Column:
    """Typed ``timestamp_ntz`` literal (T-SQL compares date strings).  Built
    from text, so neither the session nor the Python time zone moves it."""
    return F.lit(_parse(v).isoformat(sep=" ")).cast("timestamp_ntz")


def shifted_open_range(c, lo, hi, shift_years: int = 0) -> Column:
    """``DATEADD(year, k, c) > lo AND DATEADD(year, k, c) < hi`` (both strict).

    A function of the column cannot reach the parquet reader, so a looser
    range on the raw column (bounds moved back by ``k`` years, widened by
    one day to absorb the 29-February clamp) is added in front; it is
    pushed to the scan and prunes row groups, the exact predicate then
    decides.
    """
    lo_d, hi_d = _parse(lo), _parse(hi)
    exact = (add_years(c, shift_years) > ts_lit(lo_d)) & (add_years(c, shift_years) < ts_lit(hi_d))
    if shift_years == 0:
        return exact
    loose_lo = _minus_years(lo_d, shift_years) - _dt.timedelta(days=1)
    loose_hi = _minus_years(hi_d, shift_years) + _dt.timedelta(days=1)
    return (col(c) > ts_lit(loose_lo)) & (col(c) < ts_lit(loose_hi)) & exact


def _minus_years(d: _dt.datetime, years: int) -> _dt.datetime:
    y = d.year - years
    try:
        return d.replace(year=y)
    except ValueError:  # 29 Feb into a non-leap year
        return d.replace(year=y, day=28)
