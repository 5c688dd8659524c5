"""String helpers (H5, H6, H8, H9, H12, B21, B22)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tidewater.functions.na import col


def like_class_to_regex(pattern: str) -> str:
    """Translate a T-SQL ``LIKE`` pattern with ``[..]`` classes into an
    anchored Java regex.  ``%`` → ``.*``, ``_`` → ``.``; bracket classes are
    kept; every other character is literal."""
    out, i = ["^"], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "[":
            j = pattern.index("]", i)
            body = pattern[i + 1:j]
            if body.startswith("^"):
                body = "^" + body[1:]
            out.append("[" + body + "]")
            i = j + 1
            continue
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch))
        i += 1
    out.append("$")
    return "".join(out)


def like_class(c, pattern: str) -> Column:
    """T-SQL ``c LIKE '[3-4]2[1-4]'`` (Spark ``LIKE`` has no classes)."""
    return col(c).rlike(like_class_to_regex(pattern))


def concat_codes(*cols) -> Column:
    """T-SQL ``CONCAT(a, b, c)`` over integers: NULL reads as ''."""
    return F.concat(*[F.coalesce(col(c).cast("string"), F.lit("")) for c in cols])


def digits_only(c) -> Column:
    """R ``gsub("[^0-9]", "", s)``."""
    return F.regexp_replace(col(c), "[^0-9]", "")


def _sql_ref(c) -> str:
    if isinstance(c, str):
        return "`" + c.replace("`", "``") + "`"
    raise TypeError("to_number expects a column name")


def num_text(c) -> Column:
    """R ``paste0`` of a number: ``11`` not ``11.0``; NA prints ``NA``."""
    s = col(c).cast("string")
    return F.coalesce(F.regexp_replace(s, r"\.0$", ""), F.lit("NA"))


def share_label(value, pct, value_digits: int = 2, pct_digits: int = 1) -> Column:
    """``paste0(round(v, 2), " (", round(p, 1), "%)")`` → ``"11.4 (30.7%)"``."""
    return F.concat(num_text(F.bround(col(value), value_digits)), F.lit(" ("),
                    num_text(F.bround(col(pct), pct_digits)), F.lit("%)"))
