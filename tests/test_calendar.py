"""P03 / P04 period resolution, hand-computed edge cases (no Spark needed)."""

import datetime as dt

import pytest

from sellerlens.functions.calendar import months_between, quick_period, quick_range, resolve_period
from sellerlens.functions.dates import add_months, last_months_window, two_year_window

D = dt.date


def test_month_mode_mid_month():
    p = resolve_period(D(2001, 7, 19), "month")
    assert not p.daily and p.months == (D(2001, 7, 1),)
    assert p.months_before == (D(2001, 6, 1),) and p.months_last_year == (D(2000, 7, 1),)
    assert p.chart_daily and p.chart_days == (D(2001, 7, 1), D(2001, 7, 18))


def test_month_mode_january_rolls_year():
    p = resolve_period(D(2024, 1, 1), "month")
    assert p.months_before == (D(2023, 12, 1),) and p.months_last_year == (D(2023, 1, 1),)
    # on the 1st the chart range is empty (start after end)
    assert p.chart_days == (D(2024, 1, 1), D(2023, 12, 31))


def test_day_mode():
    p = resolve_period(D(2024, 3, 1), "day")
    assert p.days == (D(2024, 2, 29), D(2024, 2, 29))
    assert p.days_before == (D(2024, 2, 28), D(2024, 2, 28))
    assert p.chart_days == (D(2024, 1, 31), D(2024, 2, 29))
    assert p.months_last_year is None


@pytest.mark.parametrize("as_of, start, end", [
    (D(2001, 7, 19), D(2001, 7, 8), D(2001, 7, 14)),   # Thursday
    (D(2024, 3, 2), D(2024, 2, 18), D(2024, 2, 24)),   # Saturday: the week ended 7 days ago
    (D(2024, 3, 3), D(2024, 2, 25), D(2024, 3, 2)),    # Sunday: yesterday closed the week
    (D(2024, 3, 31), D(2024, 3, 24), D(2024, 3, 30)),  # Sunday, month end
])
def test_week_mode(as_of, start, end):
    p = resolve_period(as_of, "week")
    assert p.days == (start, end)
    assert p.days_before == (start - dt.timedelta(days=7), start - dt.timedelta(days=1))
    assert (end - start).days == 6 and end.weekday() == 5  # Saturday


def test_quarter_mode_first_quarter_compares_previous_year():
    p = resolve_period(D(2024, 2, 29), "quarter")
    assert p.months == (D(2024, 1, 1), D(2024, 2, 1))
    assert p.months_before == (D(2023, 10, 1), D(2023, 11, 1))
    assert p.months_last_year == (D(2023, 1, 1), D(2023, 2, 1))


def test_quarter_mode_first_day_of_quarter():
    p = resolve_period(D(2024, 4, 1), "quarter")
    assert p.months == (D(2024, 4, 1),) and p.months_before == (D(2024, 1, 1),)


def test_year_mode_has_no_first_comparison():
    p = resolve_period(D(2001, 7, 19), "year")
    assert p.months == tuple(D(2001, m, 1) for m in range(1, 8))
    assert p.months_before is None and p.months_last_year[0] == D(2000, 1, 1)


def test_custom_mode_spans_and_overlaps():
    p = resolve_period(D(2001, 7, 19), "custom", D(2000, 11, 10), D(2001, 2, 3))
    assert p.months == (D(2000, 11, 1), D(2000, 12, 1), D(2001, 1, 1), D(2001, 2, 1))
    assert p.months_before == (D(2000, 10, 1), D(2000, 11, 1), D(2000, 12, 1), D(2001, 1, 1))  # overlaps curr


def test_custom_end_before_start_falls_back_to_start_month():
    p = resolve_period(D(2001, 7, 19), "custom", D(2001, 3, 15), D(2001, 1, 2))
    assert p.months == (D(2001, 3, 1),)


def test_custom_end_defaults_to_start():
    p = resolve_period(D(2001, 7, 19), "custom", D(2001, 3, 15))
    assert p.months == (D(2001, 3, 1),)


def test_quick_ranges():
    a = D(2024, 3, 2)  # Saturday
    assert quick_range(a, "yesterday") == (D(2024, 3, 1), D(2024, 3, 1))
    assert quick_range(a, "last-week") == (D(2024, 2, 18), D(2024, 2, 24))
    assert quick_range(a, "this-month") == (D(2024, 3, 1), a)
    assert quick_range(a, "last-month") == (D(2024, 2, 1), D(2024, 2, 29))
    assert quick_range(D(2024, 1, 10), "last-month") == (D(2023, 12, 1), D(2023, 12, 31))
    assert quick_range(D(2024, 5, 20), "this-quarter") == (D(2024, 4, 1), D(2024, 5, 20))
    assert quick_range(a, "this-year") == (D(2024, 1, 1), a)


def test_quick_yesterday_reports_whole_month():
    p = quick_period(D(2024, 3, 1), "yesterday")
    assert p.mode == "custom" and p.months == (D(2024, 2, 1),)


def test_windows_and_month_arithmetic():
    assert two_year_window(D(2024, 2, 29)).start == D(2023, 1, 1)
    assert last_months_window(D(2024, 5, 31), 3).start == D(2024, 2, 29)
    assert last_months_window(D(2023, 5, 31), 3).start == D(2023, 2, 28)
    assert add_months(D(2024, 1, 31), 1) == D(2024, 2, 29)
    assert months_between(D(2023, 11, 5), D(2024, 2, 1))[-1] == D(2024, 2, 1)


def test_unknown_mode_rejected():
    with pytest.raises(ValueError):
        resolve_period(D(2024, 1, 1), "fortnight")
