"""Scalar column functions for cleaning raw text columns.

All are JVM expressions (no Python per row). Spark 4 runs with ANSI mode on,
where a plain ``cast('' as double)`` raises; the ``try_*`` forms return NULL
for bad input, which is the behaviour the cleaning steps rely on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def try_number(col, to: str = "double") -> Column:
    """Cast text to a number; NULL when the text is not a number (F1). Integer
    targets drop the fraction of decimal text ('123.0' is 123)."""
    text = F.trim(_c(col))
    if to in ("int", "long", "bigint"):
        return F.coalesce(text.try_cast(to), F.when(text.rlike(r"^[+-]?[0-9]+\.[0-9]*$"), F.split_part(text, F.lit("."), F.lit(1)).try_cast(to)))
    return text.try_cast(to)


def parse_grouped_int(col) -> Column:
    """'1234' or '1,234' -> 1234; anything else -> NULL (F2)."""
    c = _c(col)
    return (F.when(c.rlike(r"^[0-9]+$"), c.try_cast("long"))
             .when(c.rlike(r"^[0-9,]+$"), F.regexp_replace(c, ",", "").try_cast("long")))


def zero_to_null(col) -> Column:
    """0 -> NULL, otherwise the value."""
    return F.nullif(_c(col), F.lit(0))


def text_bool(col, true_text: str = "True", false_text: str = "False") -> Column:
    """Exact 'True' / 'False' -> boolean, anything else -> NULL."""
    c = _c(col)
    return F.when(c == true_text, F.lit(True)).when(c == false_text, F.lit(False))


def parse_date(col, fmt: str | None = None) -> Column:
    """Text -> date, NULL when it does not parse."""
    c = _c(col)
    return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)


def year_flags(year_col, earliest: int = 1895, latest: int = 2025) -> tuple[Column, Column]:
    """Implausible release years: before the first film, after the data cut."""
    y = _c(year_col)
    return (y < earliest), (y > latest)


def safe_ratio(num, den) -> Column:
    """num / den when both are positive, else NULL (F18, ROI)."""
    n, d = _c(num), _c(den)
    return F.when((n > 0) & (d > 0), F.try_divide(n, d))


def winsorize(col, cap) -> Column:
    """Cap values above ``cap``; NULL stays NULL.

    ``least`` is not used on purpose: it skips NULL and would return the cap.
    """
    c = _c(col)
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    return F.when(c > cap, cap).otherwise(c)


def score_text(col) -> Column:
    """'8/10' -> 8.0; missing or malformed -> NULL."""
    return F.trim(F.split_part(_c(col), F.lit("/"), F.lit(1))).try_cast("double")


def after_label(col, label: str) -> Column:
    """Text after a fixed label, e.g. 'Genre: Drama' -> 'Drama' (F23); NULL if absent."""
    c = _c(col)
    return F.when(F.startswith(c, F.lit(label)), c.substr(F.lit(len(label) + 1), F.length(c)))
