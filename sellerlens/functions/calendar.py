"""Report periods (P03) and quick ranges (P04), relative to an explicit as-of date.

A period is a number of days or of calendar months, with the stretches it is
compared to and what its chart shows. Both kinds come from one table of modes:
a mode has a unit and a length, and the period is the last one of that length that
the as-of date closes (days) or lies in (months, up to the as-of date's own).

Months are counted from year 0, so a month, a quarter and a year begin where
their length divides the number, and a comparison is a shift of the numbers.

`resolve_period` gives one date's literals, which Catalyst folds into pushed predicates.
`period_rows` gives the same as rows (as_of, role, first, last) for many dates: a table that
daily marts meet by an interval join (`measures.sums_of_periods`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from typing import NamedTuple

from sellerlens.functions.dates import month_end

DayRange = tuple[dt.date, dt.date]
DAY = dt.timedelta(days=1)
SATURDAY = 5


class Mode(NamedTuple):
    """`ends_on`: the weekday that a run of days ends on, else yesterday. `back`: by how many months the
    first comparison lies back. `chart`: how many days up to yesterday a chart shows, 0 for those of the period; None for its months."""

    unit: str
    length: int = 0
    ends_on: int | None = None
    back: int | None = None
    chart: int | None = None


MODES = {
    "day": Mode("day", 1, chart=30),
    "week": Mode("day", 7, ends_on=SATURDAY, chart=28),
    "month": Mode("month", 1, back=1, chart=0),
    "quarter": Mode("month", 3, back=3),
    "year": Mode("month", 12),
    "custom": Mode("month", back=1),
}
#: Quick ranges: the mode whose period they are, and how many of its lengths they lie back; one that lies back is whole.
QUICK = {
    "yesterday": ("day", 0), "last-week": ("week", 0), "this-month": ("month", 0), "last-month": ("month", 1),
    "this-quarter": ("quarter", 0), "this-year": ("year", 0),
}


@dataclass(frozen=True)
class Period:
    """Days (ends included) or months, and the ones before and a year before; None for a comparison that the mode lacks."""

    mode: str
    days: DayRange | None = None
    days_before: DayRange | None = None
    months: tuple[dt.date, ...] = ()
    months_before: tuple[dt.date, ...] | None = None
    months_last_year: tuple[dt.date, ...] | None = None
    chart_days: DayRange | None = None
    chart_months: tuple[dt.date, ...] = ()

    @property
    def daily(self) -> bool:
        return self.days is not None

    @property
    def chart_daily(self) -> bool:
        return self.chart_days is not None

    @property
    def last_month(self) -> dt.date | None:
        return self.months[-1] if self.months else None


def _number(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


def _months(numbers: Iterable[int]) -> tuple[dt.date, ...]:
    return tuple(dt.date(n // 12, n % 12 + 1, 1) for n in numbers)


def months_between(start: dt.date, end: dt.date) -> tuple[dt.date, ...]:
    return _months(range(_number(start), _number(end) + 1))


def _run_of_days(as_of: dt.date, mode: Mode) -> DayRange:
    """The last run of the mode's days that is over before as_of."""
    last = as_of - DAY
    if mode.ends_on is not None:
        last -= (last.weekday() - mode.ends_on) % 7 * DAY
    return last - (mode.length - 1) * DAY, last


def resolve_period(as_of: dt.date, mode: str = "month", start: dt.date | None = None, end: dt.date | None = None) -> Period:
    """The period of a mode; a custom one is of the months from `start` to `end` (its own month without an end)."""
    if mode not in MODES:
        raise ValueError(f"unknown period mode {mode!r}; expected one of {tuple(MODES)}")
    if mode == "custom" and start is None:
        raise ValueError("a custom period needs a start")
    m = MODES[mode]
    yesterday = as_of - DAY
    if m.unit == "day":
        first, last = _run_of_days(as_of, m)
        return Period(mode, days=(first, last), days_before=(first - m.length * DAY, first - DAY), chart_days=(as_of - m.chart * DAY, yesterday))
    if mode == "custom":
        numbers = range(_number(start), max(_number(start), _number(end or start)) + 1)
    else:
        now = _number(as_of)
        numbers = range(now - now % m.length, now + 1)
    months = _months(numbers)
    return Period(
        mode, months=months,
        months_before=_months(n - m.back for n in numbers) if m.back else None,
        months_last_year=_months(n - 12 for n in numbers),
        chart_days=(months[0], yesterday) if m.chart == 0 else None,
        chart_months=() if m.chart == 0 else months,
    )


def quick_range(as_of: dt.date, key: str) -> DayRange:
    """Named range -> (start, end); reports then treat it as a custom period."""
    if key not in QUICK:
        raise ValueError(f"unknown quick range {key!r}; expected one of {tuple(QUICK)}")
    name, back = QUICK[key]
    m = MODES[name]
    if m.unit == "day":
        return _run_of_days(as_of, m)
    now = _number(as_of)
    first, = _months([now - now % m.length - back * m.length])
    return first, as_of if not back else month_end(_months([_number(first) + m.length - 1])[0])


def quick_period(as_of: dt.date, key: str) -> Period:
    return resolve_period(as_of, "custom", *quick_range(as_of, key))


def _spans(months: Iterable[dt.date]) -> list[DayRange]:
    return [(m, month_end(m)) for m in months]


def needed_days(period: Period) -> tuple[DayRange, ...]:
    """The days that a report of this period reads, as disjoint ranges in order; neighbours are one."""
    ranges = [r for r in (period.days, period.days_before, period.chart_days) if r and r[0] <= r[1]]
    for months in (period.months, period.months_before or (), period.months_last_year or (), period.chart_months):
        ranges += _spans(months)
    out: list[DayRange] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + DAY:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return tuple(out)


def period_rows(as_ofs: Iterable[dt.date], mode: str, start: dt.date | None = None,
                end: dt.date | None = None) -> list[tuple[dt.date, str, dt.date, dt.date]]:
    """The periods of many as-of dates as rows: as_of, role ("current", "before", "last_year"), first day, last day.

    Data ends the day before as_of, so no range goes beyond it.
    """
    rows = []
    for as_of in as_ofs:
        p = resolve_period(as_of, mode, start, end)
        roles = {"current": [p.days] if p.daily else _spans(p.months), "before": [p.days_before] if p.daily else _spans(p.months_before or ()),
                 "last_year": _spans(p.months_last_year or ())}
        rows += [(as_of, role, first, min(last, as_of - DAY)) for role, spans in roles.items() for first, last in spans if first < as_of]
    return rows
