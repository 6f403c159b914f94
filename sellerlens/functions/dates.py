"""Reporting windows relative to an explicit as-of date.

The windows are plain calendar arithmetic on one date, done once on the driver
and handed to Catalyst as literals, so they fold into pushed scan filters.
All windows are half-open [start, end): as_of itself is never reported.
"""

from __future__ import annotations

import calendar
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months(d: dt.date, n: int) -> dt.date:
    """Calendar month shift with end-of-month clamping (Jan 31 + 1 -> Feb 28/29)."""
    idx = d.year * 12 + (d.month - 1) + n
    y, m = divmod(idx, 12)
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))


def month_start(d: dt.date) -> dt.date:
    return d.replace(day=1)


def month_end(d: dt.date) -> dt.date:
    return d.replace(day=calendar.monthrange(d.year, d.month)[1])


@dataclass(frozen=True)
class DayWindow:
    start: dt.date
    end: dt.date | None  # exclusive; None = open-ended

    def predicate(self, col: str | Column) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        cond = c >= F.lit(self.start)
        if self.end is not None:
            cond = cond & (c < F.lit(self.end))
        return cond


def two_year_window(as_of: dt.date) -> DayWindow:
    """From January 1st of last year up to (excluding) as_of: 12-24 months."""
    return DayWindow(dt.date(as_of.year - 1, 1, 1), as_of)


def last_days_window(as_of: dt.date, days: int) -> DayWindow:
    return DayWindow(as_of - dt.timedelta(days=days), as_of)


def last_months_window(as_of: dt.date, months: int) -> DayWindow:
    return DayWindow(add_months(as_of, -months), as_of)


def since_window(as_of: dt.date, days: int) -> DayWindow:
    """Open-ended: every day from as_of - days on (no upper bound)."""
    return DayWindow(as_of - dt.timedelta(days=days), None)
