"""Period- and scope-aware measures over marts.

Inputs are marts keyed by (month | day, seller_id). Every measure is computed
for all scopes at once: the mart is joined to the scope bridge on seller_id
(each seller is in at most three scopes) and aggregated per scope with
conditional sums per period role - one aggregation, however many roles.
Zero-fill ("absent = 0") is a left join from the distinct scope list (one row
per scope on both sides, so no hot key), or an `explode` of the literal month
list for series - never a cross join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions.calendar import Period, period_rows
from sellerlens.functions.ratios import pct_change, rounded_money_ratio
from sellerlens.plans.broadcast import broadcast_if_small, is_small

Fields = Sequence[str]


def _zero(f: str) -> Column:
    return F.coalesce(F.col(f), F.lit(0))


def scope_list(bridge: DataFrame) -> DataFrame:
    return bridge.select("scope").distinct()


def scoped(mart: DataFrame, bridge: DataFrame) -> DataFrame:
    """Fan per-seller mart rows out to their scopes (bridge broadcast when small)."""
    b = bridge.select("scope", "seller_id")
    return mart.join(F.broadcast(b) if is_small(bridge) else b, "seller_id")


def _zero_fill(per_scope: DataFrame, bridge: DataFrame, cols: Fields) -> DataFrame:
    filled = scope_list(bridge).join(per_scope, "scope", "left")
    return filled.select("scope", *[_zero(c).alias(c) for c in cols],
                         *[c for c in per_scope.columns if c != "scope" and c not in cols])


# ----------------------------------------------------------------------------- P05 / P06
def rollup_months(mart: DataFrame, fields: Fields, bridge: DataFrame) -> DataFrame:
    """(scope, month, Σ fields) over months present for the scope; NULL counts 0."""
    return scoped(mart, bridge).groupBy("scope", "month").agg(*[F.sum(_zero(f)).alias(f) for f in fields])


def rollup_months_current_year(mart: DataFrame, fields: Fields, bridge: DataFrame, as_of: dt.date) -> DataFrame:
    """P05 restricted to months of as_of's year."""
    start, end = dt.date(as_of.year, 1, 1), dt.date(as_of.year + 1, 1, 1)
    m = mart.where((F.col("month") >= F.lit(start)) & (F.col("month") < F.lit(end)))
    return rollup_months(m, fields, bridge)


# ----------------------------------------------------------------------------- P07 / P08 / P09
def sum_months(mart: DataFrame, fields: Fields, months: Sequence[dt.date], bridge: DataFrame) -> DataFrame:
    """(scope, Σ fields) over a month set; absent months and scopes give 0."""
    m = mart.where(F.col("month").isin(list(months))) if months else mart.where(F.lit(False))
    sums = scoped(m, bridge).groupBy("scope").agg(*[F.sum(_zero(f)).alias(f) for f in fields])
    return _zero_fill(sums, bridge, fields)


def sum_daily_range(mart: DataFrame, fields: Fields, start: dt.date, end: dt.date, bridge: DataFrame) -> DataFrame:
    """(scope, Σ fields) over days in [start, end] inclusive; absent = 0."""
    m = mart.where(F.col("day").between(F.lit(start), F.lit(end)))
    sums = scoped(m, bridge).groupBy("scope").agg(*[F.sum(_zero(f)).alias(f) for f in fields])
    return _zero_fill(sums, bridge, fields)


def _period_filter(mart: DataFrame, period: Period) -> DataFrame:
    if period.daily:
        s, e = period.days
        return mart.where(F.col("day").between(F.lit(s), F.lit(e)))
    return mart.where(F.col("month").isin(list(period.months)))


def rollup_sellers(mart: DataFrame, fields: Fields, bridge: DataFrame, period: Period) -> DataFrame:
    """(scope, seller_id, Σ fields) over the current period; sellers with rows only.

    A daily period reads a daily mart (column `day`), a monthly one a monthly
    mart (column `month`).
    """
    m = _period_filter(mart, period)
    return scoped(m, bridge).groupBy("scope", "seller_id").agg(*[F.sum(_zero(f)).alias(f) for f in fields])


# ----------------------------------------------------------------------------- P10 / P11 / P12
def daily_series(mart: DataFrame, fields: Fields | str, start: dt.date, end: dt.date, bridge: DataFrame) -> DataFrame:
    """(scope, day, Σ fields) for days in [start, end] that have rows."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    m = mart.where(F.col("day").between(F.lit(start), F.lit(end)))
    return scoped(m, bridge).groupBy("scope", "day").agg(*[F.sum(_zero(f)).alias(f) for f in fields])


daily_series_multi = daily_series


def month_grid(bridge: DataFrame, months: Sequence[dt.date]) -> DataFrame:
    """Every (scope, month) of a literal month list, by exploding an array (no join)."""
    arr = F.array(*[F.lit(m) for m in months]) if months else F.array().cast("array<date>")
    return scope_list(bridge).select("scope", F.explode(arr).alias("month"))


def monthly_series(mart: DataFrame, fields: Fields | str, months: Sequence[dt.date], bridge: DataFrame) -> DataFrame:
    """One row per (scope, period month); absent month = 0."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    m = mart.where(F.col("month").isin(list(months))) if months else mart.where(F.lit(False))
    roll = rollup_months(m, fields, bridge)
    grid = month_grid(bridge, months)
    return grid.join(roll, ["scope", "month"], "left").select(
        "scope", "month", *[_zero(f).alias(f) for f in fields]
    )


# ----------------------------------------------------------------------------- P13
def chart_window_series(monthly: DataFrame, daily: DataFrame, field: str, period: Period,
                        bridge: DataFrame, as_of: dt.date) -> DataFrame:
    """The series a chart draws for a period mode -> (scope, label, value).

    daily modes: days of the current range with rows; month: the last 12
    months present for the scope (ending at its newest present month);
    quarter / custom: the period months (absent = 0); year: months of as_of's
    year present for the scope.
    """
    if period.daily:
        s, e = period.days
        out = daily_series(daily, [field], s, e, bridge)
        return out.select("scope", F.col("day").cast("string").alias("label"), F.col(field).alias("value"))
    if period.mode == "month":
        roll = rollup_months(monthly, [field], bridge)
        w = Window.partitionBy("scope").orderBy(F.col("month").desc())
        out = roll.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= 12)
        return out.select("scope", F.date_format("month", "yyyy-MM").alias("label"), F.col(field).alias("value"))
    if period.mode == "year":
        out = rollup_months_current_year(monthly, [field], bridge, as_of)
        return out.select("scope", F.date_format("month", "yyyy-MM").alias("label"), F.col(field).alias("value"))
    out = monthly_series(monthly, [field], period.months, bridge)
    return out.select("scope", F.date_format("month", "yyyy-MM").alias("label"), F.col(field).alias("value"))


# ----------------------------------------------------------------------------- P14 / P15
def period_sums(monthly: DataFrame | None, daily: DataFrame | None, fields: Fields, period: Period,
                bridge: DataFrame) -> DataFrame:
    """(scope, f_curr, f_d1, f_d2 ...) in one conditional aggregation; absent = 0.

    Roles a period does not have are NULL columns.
    """
    cols: list[Column] = []
    names: list[str] = []
    if period.daily:
        (cs, ce), prev = period.days, period.days_before
        roles = {"curr": F.col("day").between(F.lit(cs), F.lit(ce))}
        if prev:
            roles["d1"] = F.col("day").between(F.lit(prev[0]), F.lit(prev[1]))
        src = daily
    else:
        roles = {"curr": F.col("month").isin(list(period.months))}
        if period.months_before:
            roles["d1"] = F.col("month").isin(list(period.months_before))
        if period.months_last_year:
            roles["d2"] = F.col("month").isin(list(period.months_last_year))
        src = monthly
    any_role = None
    for cond in roles.values():
        any_role = cond if any_role is None else any_role | cond
    for f in fields:
        for role, cond in roles.items():
            cols.append(F.sum(F.when(cond, _zero(f)).otherwise(F.lit(0))).alias(f"{f}_{role}"))
            names.append(f"{f}_{role}")
    sums = scoped(src.where(any_role), bridge).groupBy("scope").agg(*cols)
    out = _zero_fill(sums, bridge, names)
    for f in fields:
        for role in ("d1", "d2"):
            if role not in roles:
                out = out.withColumn(f"{f}_{role}", F.lit(None).cast("double"))
    return out


def kpi_delta(monthly: DataFrame | None, daily: DataFrame | None, fields: Fields, period: Period,
              bridge: DataFrame) -> DataFrame:
    """Per scope, each field's value and its % change vs the two comparisons.

    d1 = (value - p) / p * 100 against the previous month / quarter months /
    previous day range, d2 against the same months a year earlier; NULL when
    the comparison sum is 0 or the period has no such comparison.
    """
    s = period_sums(monthly, daily, fields, period, bridge)
    out = [F.col("scope")]
    for f in fields:
        out += [F.col(f"{f}_curr").alias(f), pct_change(f"{f}_curr", f"{f}_d1").alias(f"{f}_d1"),
                pct_change(f"{f}_curr", f"{f}_d2").alias(f"{f}_d2")]
    return s.select(*out)


def _ratio_or_null(num: str, den: str) -> Column:
    return F.try_divide(F.col(num).cast("double"), F.col(den).cast("double"))


def asp_kpi(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame,
            gmv: str = "gmv", units: str = "si") -> DataFrame:
    """Σgmv/Σunits (0 without units) and % change of the ratio itself.

    The comparison ratio is NULL without units; a delta is NULL when that
    ratio is NULL or 0, and in daily modes also when the current ratio is 0.
    """
    s = period_sums(monthly, daily, [gmv, units], period, bridge)
    cur = F.coalesce(_ratio_or_null(f"{gmv}_curr", f"{units}_curr"), F.lit(0.0))
    s = s.select(
        "scope", cur.alias("asp"),
        _ratio_or_null(f"{gmv}_d1", f"{units}_d1").alias("_p1"),
        _ratio_or_null(f"{gmv}_d2", f"{units}_d2").alias("_p2"),
    )

    def delta(p: str) -> Column:
        ok = F.col(p).isNotNull() & (F.col(p) != 0)
        if period.daily:
            ok = ok & (F.col("asp") != 0)
        return F.when(ok, (F.col("asp") - F.col(p)) / F.col(p) * F.lit(100.0))

    return s.select("scope", "asp", delta("_p1").alias("asp_d1"), delta("_p2").alias("asp_d2"))


# ----------------------------------------------------------------------------- P03 / P08 / P14 of many dates
def sums_of_periods(days: DataFrame, fields: Fields, periods: DataFrame, bridge: DataFrame) -> DataFrame:
    """(as_of, role, scope, Σ fields) of rows (day, seller_id, fields) in the ranges of `periods` (as_of, role, first, last).

    A binned interval join: both sides meet by calendar month, and the exact range is checked within it, so a day is
    compared with the ranges that touch its month only. The days are summed per range and seller before they fan out to scopes.
    """
    bins = F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("INTERVAL 1 MONTH")))
    ranges = periods.where(F.col("first") <= F.col("last")).select("*", bins.alias("_bin"))
    binned = days.withColumn("_bin", F.trunc("day", "month"))
    met = binned.join(broadcast_if_small(ranges), "_bin").where(F.col("day").between(F.col("first"), F.col("last")))
    sums = [F.sum(_zero(f)).alias(f) for f in fields]
    return scoped(met.groupBy("as_of", "role", "seller_id").agg(*sums), bridge).groupBy("as_of", "role", "scope").agg(*sums)


def kpi_of_dates(days: DataFrame, fields: Fields, as_ofs: Sequence[dt.date], mode: str, bridge: DataFrame) -> DataFrame:
    """P14 for many as-of dates in one plan: (as_of, scope, f, f_d1, f_d2), each as if for that date alone.

    `days` are (day, seller_id, fields) of all days that the dates' periods touch; each is read once.
    """
    roles = {"curr": "current", "d1": "before", "d2": "last_year"}
    periods = days.sparkSession.createDataFrame(period_rows(as_ofs, mode), "as_of date, role string, first date, last date")
    sums = sums_of_periods(days, fields, periods, bridge).groupBy("as_of", "scope").agg(*[
        F.sum(F.when(F.col("role") == F.lit(role), F.col(f))).alias(f"{f}_{short}") for f in fields for short, role in roles.items()])
    dates = F.array(*[F.lit(d) for d in sorted(set(as_ofs))])
    t = scope_list(bridge).select("scope", F.explode(dates).alias("as_of")).join(sums, ["as_of", "scope"], "left")
    out = [F.col("as_of"), F.col("scope")]
    for f in fields:
        out.append(_zero(f"{f}_curr").alias(f))
        out += [pct_change(_zero(f"{f}_curr"), _zero(f"{f}_{r}")).alias(f"{f}_{r}") for r in ("d1", "d2")]
    return t.select(*out)


# ----------------------------------------------------------------------------- P16 / P17
def asp_series(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame,
               gmv: str = "gmv", units: str = "si") -> DataFrame:
    """(scope, label, asp) over the chart range/months, 0 dp, NULL without units."""
    if period.chart_daily:
        s, e = period.chart_days
        ser = daily_series(daily, [gmv, units], s, e, bridge)
        label = F.col("day").cast("string")
    else:
        ser = monthly_series(monthly, [gmv, units], period.chart_months, bridge)
        label = F.date_format("month", "yyyy-MM")
    return ser.select("scope", label.alias("label"), rounded_money_ratio(gmv, units, 0).alias("asp"))


def growth_series(monthly: DataFrame, bridge: DataFrame, field: str = "gmv", last: int = 12) -> DataFrame:
    """For each scope's last `last` present months, % change vs the
    previous *present* month and vs the same month a year earlier (if present).

    The year-ago month is a range frame over the month's number, so the mart is read once.
    """
    roll = rollup_months(monthly, [field], bridge).withColumn("_n", F.year("month") * 12 + F.month("month"))
    by_month = Window.partitionBy("scope").orderBy("_n")
    newest = Window.partitionBy("scope").orderBy(F.col("_n").desc())
    ranked = roll.select(
        "scope", "month", F.col(field).alias("value"),
        F.lag(field).over(by_month).alias("_prev"),
        F.max(field).over(by_month.rangeBetween(-12, -12)).alias("_yago"),
        F.row_number().over(newest).alias("_k"),
    )
    return ranked.where(F.col("_k") <= last).select(
        "scope", "month", "value",
        pct_change("value", "_prev").alias("mom_pct"),
        pct_change("value", "_yago").alias("yoy_pct"),
    )
