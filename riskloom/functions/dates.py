"""Month-grain date expressions."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_TEXT = "MMM-yyyy"
MONTH_DISPLAY = "MMM yyyy"


def parse_month(col: Column | str, strict: bool = False) -> Column:
    """``Dec-2015`` -> first day of the month.

    Bad text becomes NULL; with ``strict`` it raises (ANSI ``to_date``).
    """
    c = F.col(col) if isinstance(col, str) else col
    if strict:
        return F.to_date(c, MONTH_TEXT)
    return F.try_to_date(c, MONTH_TEXT)


def whole_months(start: Column | str, end: Column | str) -> Column:
    """Calendar months from ``start`` to ``end``; NULL if either is NULL, may be negative.

    Days are ignored, unlike Spark's ``months_between``.
    """
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))


def month_floor(col: Column | str) -> Column:
    return F.trunc(col, "month")


def month_label(col: Column | str) -> Column:
    """``2016-01`` style period text."""
    return F.date_format(col, "yyyy-MM")


def month_display(col: Column | str) -> Column:
    """``Jan 2016`` style display text."""
    return F.date_format(col, MONTH_DISPLAY)


def month_range(first: str, last: str) -> tuple[dt.date, dt.date]:
    """Inclusive day bounds of the months ``first`` .. ``last`` (``yyyy-MM``)."""
    y0, m0 = map(int, first.split("-"))
    y1, m1 = map(int, last.split("-"))
    return dt.date(y0, m0, 1), dt.date(y1, m1, calendar.monthrange(y1, m1)[1])


def in_months(col: Column | str, first: str, last: str) -> Column:
    """Inclusive month-range predicate; NULL dates do not pass."""
    c = F.col(col) if isinstance(col, str) else col
    lo, hi = month_range(first, last)
    return c.between(F.lit(lo), F.lit(hi))
