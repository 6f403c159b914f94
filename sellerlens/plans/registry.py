"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query binds the logical inputs to the source tables under `sf_dir`,
runs one operator (or a short operator chain) over the whole tables with the
fixed parameters of `params`, and normalises the output edge. Nothing is
collected; the caller triggers execution.

A report takes `Marts`: the marts of one as-of date over one set of inputs. Building one
is lazy. A report that uses a fact at several places of its plan says so in `SHARED`, and
takes it from one table that all uses share inside the plan (`sharing.in_plan`), so every report reads
each fact once, and of it only the columns of its measures. A fact that is used once goes straight into its mart.

Periodic reports take a period as well (`PERIODIC`), so a refresh can build any of
them for any mode; `REPORTS` are the combinations that are registered as queries. A query that needs only its
period's days passes them to the scans of its facts.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.functions.calendar import QUICK, Period, needed_days, period_rows, quick_period, resolve_period
from sellerlens.functions.dates import DayWindow
from sellerlens.operators import marts, price
from sellerlens.operators import measures as M
from sellerlens.operators import reports as R
from sellerlens.operators.scopes import seller_label, seller_scopes
from sellerlens.plans.params import AS_OF, AUDIT_AS_OF, AUDIT_DAYS, CAMPAIGN_DAYS, CUSTOM_END, CUSTOM_START, DATES, REFRESHED_AT
from sellerlens.plans.sharing import in_plan
from sellerlens.session import checkpoint_dir
from sellerlens.sources.bindings import LogicalInputs
from sellerlens.sources.sinks import normalize, with_refresh_stamp
from sellerlens.sources.tables import load_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: Callable[[LogicalInputs], DataFrame]) -> Callable[[LogicalInputs], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalize(fn(LogicalInputs(load_tables(spark, sf_dir))))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn

    return deco


# ----------------------------------------------------------------------------- marts (Q01-Q16)
@register("sales_monthly")
def _q01(i: LogicalInputs) -> DataFrame:
    return marts.sales_monthly(i.sales, AS_OF, i.portfolio)


@register("sales_daily")
def _q02(i: LogicalInputs) -> DataFrame:
    return marts.sales_daily(i.sales, AS_OF, i.portfolio)


@register("logistics_daily")
def _q03(i: LogicalInputs) -> DataFrame:
    return marts.logistics_daily(i.sales, AS_OF, i.portfolio)


@register("ads_daily_mart")
def _q04(i: LogicalInputs) -> DataFrame:
    return marts.ads_daily_mart(i.ads_daily, AS_OF, i.portfolio)


@register("investments_daily")
def _q05(i: LogicalInputs) -> DataFrame:
    return marts.investments_daily(i.sales, AS_OF, i.portfolio)


@register("logistics_monthly")
def _q06(i: LogicalInputs) -> DataFrame:
    return marts.logistics_monthly(i.sales, AS_OF, i.portfolio)


@register("ads_monthly_mart")
def _q07(i: LogicalInputs) -> DataFrame:
    return marts.ads_monthly_mart(i.ads_daily, AS_OF, i.portfolio)


@register("investments_monthly")
def _q08(i: LogicalInputs) -> DataFrame:
    return marts.investments_monthly(i.sales, AS_OF, i.portfolio)


@register("buybox_monthly")
def _q09(i: LogicalInputs) -> DataFrame:
    return marts.buybox_monthly(i.sales, AS_OF, i.portfolio)


@register("top_items")
def _q10(i: LogicalInputs) -> DataFrame:
    return marts.top_items(i.sales, AS_OF, i.portfolio, k=20, titles=i.item_titles)


@register("seller_reputation")
def _q11(i: LogicalInputs) -> DataFrame:
    return marts.seller_reputation(i.reputation, i.portfolio)


@register("visits_monthly")
def _q12(i: LogicalInputs) -> DataFrame:
    return marts.visits_monthly(i.visits, AS_OF, i.portfolio)


@register("visits_daily")
def _q13(i: LogicalInputs) -> DataFrame:
    return marts.visits_daily(i.visits, AS_OF, i.portfolio)


@register("top_items_by_visits")
def _q14(i: LogicalInputs) -> DataFrame:
    return marts.top_items_by_visits(i.visits, AS_OF, i.portfolio, k=50)


@register("top_items_by_visits_k5")
def _q14_k5(i: LogicalInputs) -> DataFrame:
    """Q14 with k = 5, so that the per-seller cut is exercised at small scale."""
    return marts.top_items_by_visits(i.visits, AS_OF, i.portfolio, k=5)


@register("price_last_day")
def _q15a(i: LogicalInputs) -> DataFrame:
    return price.last_day(i.price_obs, AS_OF)


@register("price_exposure")
def _q15b(i: LogicalInputs) -> DataFrame:
    return price.exposure(i.price_obs, AS_OF, i.portfolio)


@register("price_items_last_day")
def _q15c(i: LogicalInputs) -> DataFrame:
    return price.items_last_day(i.price_obs, AS_OF, i.portfolio)


@register("price_audit_latest")
def _q15d(i: LogicalInputs) -> DataFrame:
    a = price.audit_latest(i.price_audit, AUDIT_AS_OF, i.portfolio, days=AUDIT_DAYS)
    return a.select("event_id", "seller_id", "audit_item_id", "a_our_price", "a_target_price", "a_rival_name",
                    "a_rival_url", "a_permalink", "is_offender", "qualification")


def price_mart(i: LogicalInputs, limit: int | None = None) -> DataFrame:
    return price.price_competitiveness(i.price_obs, i.price_audit, AS_OF, AUDIT_AS_OF, i.portfolio,
                                       audit_days=AUDIT_DAYS, limit=limit)


@register("price_competitiveness")
def _q15(i: LogicalInputs) -> DataFrame:
    """Q15 with the reference's own cut."""
    return price_mart(i, limit=500)


@register("price_competitiveness_k5")
def _q15_k5(i: LogicalInputs) -> DataFrame:
    """Q15 cut to 5 rows, so that its order decides."""
    return price_mart(i, limit=5)


@register("price_competitiveness_all")
def _q15_all(i: LogicalInputs) -> DataFrame:
    """Q15 uncut, as the reports take it."""
    return price_mart(i)


def campaign_mart(i: LogicalInputs, limit: int | None = None) -> DataFrame:
    return marts.campaign_items(i.campaign_optin, i.campaign_eligible, AS_OF, i.portfolio,
                                days=CAMPAIGN_DAYS, limit=limit)


@register("campaign_items")
def _q16(i: LogicalInputs) -> DataFrame:
    """Q16 with the reference's own cut."""
    return campaign_mart(i, limit=1500)


@register("campaign_items_all")
def _q16_all(i: LogicalInputs) -> DataFrame:
    """Q16 uncut, as the reports take it."""
    return campaign_mart(i)


# ----------------------------------------------------------------------------- marts of one as-of date
# mart attribute -> bundle mart name (plans/bundle.py)
BUNDLE_MARTS = {
    "q01": "sales_monthly", "q02": "sales_daily", "q03": "logistics_daily", "q04": "ads_daily",
    "q05": "investments_daily", "q06": "logistics_monthly", "q07": "ads_monthly", "q08": "investments_monthly",
    "q10": "top_items", "q11": "seller_reputation", "q12": "visits_monthly", "q13": "visits_daily",
    "q14": "top_items_by_visits", "q15": "price_competitiveness", "q16": "campaign_items",
}
#: Day tables that a report may share among its marts, and the marts that roll up from each.
DAY_TABLES = {
    "sales_days": ("q01", "q02"), "investment_days": ("q02", "q05", "q08"), "ads_days": ("q04", "q07"),
}


class Marts:
    """The marts that reports need, of one as-of date.

    They are built lazily from logical inputs (any object with the frames
    of `LogicalInputs` as attributes), or taken from `prebuilt`: typed marts
    written once by the daily refresh, keyed q01..q16. `shared` names the marts and day tables that
    several places of one plan use; `days`, ranges of days (ends included), limit what is read of the daily facts.
    """

    def __init__(self, i, prebuilt: dict[str, DataFrame] | None = None, as_of: dt.date = AS_OF,
                 audit_as_of: dt.datetime = AUDIT_AS_OF, audit_days: int = AUDIT_DAYS, campaign_days: int = CAMPAIGN_DAYS,
                 shared: tuple[str, ...] = (), days: tuple[tuple[dt.date, dt.date], ...] = ()):
        self.i, self.as_of, self.audit_as_of = i, as_of, audit_as_of
        self.audit_days, self.campaign_days = audit_days, campaign_days
        self.shared, self.days = shared, days
        self.portfolio = i.portfolio
        self.bridge = seller_scopes(self.portfolio)
        self._frames = dict(prebuilt or {})
        self._lock = threading.RLock()

    def period(self, mode: str, start: dt.date | None = None, end: dt.date | None = None) -> Period:
        return resolve_period(self.as_of, mode, start, end)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or not (name in BUNDLE_MARTS or name in DAY_TABLES):
            raise AttributeError(name)
        with self._lock:
            if name not in self._frames:
                self._frames[name] = self._build(name)
            return self._frames[name]

    def _fact(self, name: str, day: str = "day") -> DataFrame:
        """A daily fact, of the days that are needed."""
        rows = getattr(self.i, name)
        if not self.days:
            return rows
        return rows.where(reduce(lambda a, b: a | b, [F.col(day).between(F.lit(s), F.lit(e)) for s, e in self.days]))

    def _build(self, name: str) -> DataFrame:
        i, as_of, pf = self.i, self.as_of, self.portfolio
        for table, members in DAY_TABLES.items():
            if name in members and table in self.shared:
                roll = marts.ads_marts_from_days if table == "ads_days" else marts.sales_marts_from_days
                return roll(getattr(self, table), as_of)[BUNDLE_MARTS[name]]
        sales, ads, visits = (lambda: self._fact("sales", "closed_date")), (lambda: self._fact("ads_daily")), (lambda: self._fact("visits"))

        def by_seller(member: str) -> DataFrame:
            needs = {"si", *next(m for names, m in marts.SALES_FAMILIES.items() if member in names)}
            return in_plan(marts.seller_day(sales(), as_of, pf, measures=tuple(needs)), ("seller_id",))

        def prices() -> DataFrame:
            days = in_plan(price.price_days(i.price_obs, as_of), ("seller_id", "catalog_id", "item_id"))
            return price.price_competitiveness(i.price_obs, i.price_audit, as_of, self.audit_as_of, pf,
                                               audit_days=self.audit_days, days_table=days)

        build = {
            "sales_days": lambda: by_seller("sales_daily"),
            "investment_days": lambda: by_seller("investments_daily"),
            "ads_days": lambda: in_plan(marts.ads_day(ads(), as_of, pf), ("seller_id",)),
            "q01": lambda: marts.sales_monthly(sales(), as_of, pf),
            "q02": lambda: marts.sales_daily(sales(), as_of, pf),
            "q03": lambda: marts.logistics_daily(sales(), as_of, pf),
            "q04": lambda: marts.ads_daily_mart(ads(), as_of, pf),
            "q05": lambda: marts.investments_daily(sales(), as_of, pf),
            "q06": lambda: marts.logistics_monthly(sales(), as_of, pf),
            "q07": lambda: marts.ads_monthly_mart(ads(), as_of, pf),
            "q08": lambda: marts.investments_monthly(sales(), as_of, pf),
            "q10": lambda: marts.top_items(i.sales, as_of, pf, k=20, titles=i.item_titles),
            "q11": lambda: marts.seller_reputation(i.reputation, pf),
            "q12": lambda: marts.visits_monthly(visits(), as_of, pf),
            "q13": lambda: marts.visits_daily(visits(), as_of, pf),
            "q14": lambda: marts.top_items_by_visits(i.visits, as_of, pf, k=50),
            "q15": prices,
            "q16": lambda: marts.campaign_items(i.campaign_optin, i.campaign_eligible, as_of, pf, days=self.campaign_days),
        }
        frame = build[name]()
        if name in self.shared and name in BUNDLE_MARTS:
            return in_plan(frame, ("seller_id", "item_id") if name == "q15" else ("seller_id",))
        return frame


#: Reports that use a fact at several places of their plans: what these places share.
SHARED: dict[str, tuple[str, ...]] = {
    "seller_sales_table": ("q01", "q02"), "ads_kpi": ("q01", "q02"), "ads_ratios": ("q01",),
    "ads_seller_table": ("q01", "q02", "q04", "q07"),
    "investment_seller_table": ("investment_days",), "scorecard": ("sales_days",), "catalog_table": ("q10",),
    "qualification_table": ("q15",),
}
#: Periodic reports that look beyond their period (the newest months that are present, the month before).
WHOLE_HISTORY = ("chart_window_series", "ads_kpi", "ads_seller_table")


# ----------------------------------------------------------------------------- reports
PERIODIC: dict[str, Callable[[Marts, Period], DataFrame]] = {
    "chart_window_series": lambda m, p: M.chart_window_series(m.q01, m.q02, "gmv", p, m.bridge, m.as_of),
    "sales_kpi": lambda m, p: M.kpi_delta(m.q01, m.q02, ["gmv", "si"], p, m.bridge),
    "asp_kpi": lambda m, p: M.asp_kpi(m.q01, m.q02, p, m.bridge),
    "asp_series": lambda m, p: M.asp_series(m.q01, m.q02, p, m.bridge),
    "seller_sales_table": lambda m, p: R.seller_sales_table(m.q01, m.q02, p, m.bridge, m.portfolio),
    "logistics_mix": lambda m, p: R.logistics_mix(m.q06, m.q03, p, m.bridge),
    "logistics_series": lambda m, p: R.logistics_series(m.q06, m.q03, p, m.bridge),
    "logistics_seller_table": lambda m, p: R.logistics_seller_table(m.q06, m.q03, p, m.bridge, m.portfolio),
    "ads_kpi": lambda m, p: R.ads_kpi(m.q07, m.q04, m.q01, m.q02, p, m.bridge),
    "ads_series": lambda m, p: R.ads_series(m.q07, m.q04, m.q01, m.q02, p, m.bridge),
    "ads_seller_table": lambda m, p: R.ads_seller_table(m.q07, m.q04, m.q01, m.q02, p, m.bridge, m.portfolio),
    "investment_totals": lambda m, p: R.investment_totals(m.q08, m.q05, p, m.bridge),
    "investment_mix": lambda m, p: R.investment_mix(m.q08, m.q05, p, m.bridge),
    "investment_series": lambda m, p: R.investment_series(m.q08, m.q05, p, m.bridge),
    "investment_seller_table": lambda m, p: R.investment_seller_table(m.q08, m.q05, m.q02, p, m.bridge, m.portfolio),
    "visit_kpi": lambda m, p: R.visit_kpi(m.q12, m.q13, m.q01, m.q02, p, m.bridge),
    "conversion_series": lambda m, p: R.conversion_series(m.q12, m.q13, m.q01, m.q02, p, m.bridge),
    "visits_seller_table": lambda m, p: R.visits_seller_table(m.q12, m.q13, m.q01, m.q02, p, m.bridge, m.portfolio),
}


def period_of(m: Marts, mode: str | tuple[dt.date, dt.date]) -> Period:
    """A mode, a quick range ("last_month"), or a range of the caller; "custom" alone has the fixed test range."""
    if not isinstance(mode, str):
        return m.period("custom", *mode)
    if mode == "custom":
        return m.period("custom", CUSTOM_START, CUSTOM_END)
    quick = mode.replace("_", "-")
    return quick_period(m.as_of, quick) if quick in QUICK else m.period(mode)


#: query name -> (periodic report, mode)
PERIOD_QUERIES: dict[str, tuple[str, str]] = {
    **{f"chart_window_series_{x}": ("chart_window_series", x) for x in ("month", "year", "week", "quarter")},
    **{f"sales_kpi_{x}": ("sales_kpi", x) for x in (
        "day", "week", "month", "quarter", "year", "custom", *(q.replace("-", "_") for q in QUICK))},
    **{f"asp_kpi_{x}": ("asp_kpi", x) for x in ("month", "week")},
    **{f"asp_series_{x}": ("asp_series", x) for x in ("month", "quarter")},
    **{base if x == "month" else f"{base}_{x}": (base, x) for base, modes in {
        "seller_sales_table": ("month", "week"), "logistics_mix": ("month", "week"),
        "logistics_series": ("month", "quarter"), "logistics_seller_table": ("month", "week"),
        "ads_kpi": ("month", "week", "quarter"), "ads_series": ("month", "quarter"), "ads_seller_table": ("month", "week"),
        "investment_totals": ("month", "week"), "investment_mix": ("month",), "investment_series": ("month", "quarter"),
        "investment_seller_table": ("month", "week"), "visit_kpi": ("month", "week"), "visits_seller_table": ("month", "week"),
    }.items() for x in modes},
    "conversion_series": ("conversion_series", "quarter"), "conversion_series_month": ("conversion_series", "month"),
    "conversion_series_week": ("conversion_series", "week"),
}

REPORTS: dict[str, Callable[[Marts], DataFrame]] = {}


def report(name: str, base: str | None = None, mode: str | None = None):
    """Registers a report over marts, and its query: the same over marts built for it."""
    def deco(fn: Callable[[Marts], DataFrame]):
        def query(i: LogicalInputs) -> DataFrame:
            m = Marts(i, shared=SHARED.get(base or name, ()))
            if mode is not None and base not in WHOLE_HISTORY:
                m.days = needed_days(period_of(m, mode))
            return fn(m)

        query.__doc__ = fn.__doc__
        REPORTS[name] = fn
        register(name)(query)
        return fn

    return deco


def _periodic(base: str, mode: str) -> Callable[[Marts], DataFrame]:
    def run(m: Marts) -> DataFrame:
        return PERIODIC[base](m, period_of(m, mode))

    run.__doc__ = f"{base}, {mode} period."
    return run


for _name, (_base, _mode) in PERIOD_QUERIES.items():
    report(_name, _base, _mode)(_periodic(_base, _mode))


@report("seller_scopes")
def _p01(m: Marts) -> DataFrame:
    return m.bridge


@report("seller_labels")
def _p02(m: Marts) -> DataFrame:
    return seller_label(m.q01.select("seller_id").distinct(), m.portfolio)


@report("months_rollup")
def _p05(m: Marts) -> DataFrame:
    return M.rollup_months(m.q01, ["gmv", "si"], m.bridge)


@report("months_rollup_current_year")
def _p06(m: Marts) -> DataFrame:
    return M.rollup_months_current_year(m.q01, ["gmv", "si"], m.bridge, m.as_of)


@report("sum_months_quarter")
def _p07(m: Marts) -> DataFrame:
    return M.sum_months(m.q01, ["gmv", "si"], m.period("quarter").months, m.bridge)


@report("sum_daily_range_week")
def _p08(m: Marts) -> DataFrame:
    return M.sum_daily_range(m.q02, ["gmv", "si"], *m.period("week").days, m.bridge)


@report("rollup_sellers_month")
def _p09(m: Marts) -> DataFrame:
    return M.rollup_sellers(m.q01, ["gmv", "si"], m.bridge, m.period("month"))


@report("daily_series_month")
def _p10(m: Marts) -> DataFrame:
    return M.daily_series(m.q02, "gmv", *m.period("month").chart_days, m.bridge)


@report("daily_series_multi_day")
def _p11(m: Marts) -> DataFrame:
    return M.daily_series_multi(m.q02, ["gmv", "si"], *m.period("day").chart_days, m.bridge)


@report("monthly_series_year")
def _p12(m: Marts) -> DataFrame:
    return M.monthly_series(m.q01, ["gmv", "si"], m.period("year").months, m.bridge)


def _kpi_of_dates(i: LogicalInputs, mode: str) -> DataFrame:
    rows = period_rows(DATES, mode)
    window = DayWindow(min(r[2] for r in rows), max(r[3] for r in rows) + dt.timedelta(days=1))
    days = marts.seller_day(i.sales, max(DATES), i.portfolio, measures=("gmv", "si"), window=window)
    return M.kpi_of_dates(days, ["gmv", "si"], DATES, mode, seller_scopes(i.portfolio))


@register("sales_kpi_dates")
def _p14_dates(i: LogicalInputs) -> DataFrame:
    """P14 for 30 as-of dates in one plan, month period."""
    return _kpi_of_dates(i, "month")


@register("sales_kpi_dates_week")
def _p14_dates_week(i: LogicalInputs) -> DataFrame:
    """P14 for 30 as-of dates in one plan, week period."""
    return _kpi_of_dates(i, "week")


@report("growth_series")
def _p17(m: Marts) -> DataFrame:
    return M.growth_series(m.q01, m.bridge)


@report("ads_ratios")
def _p22(m: Marts) -> DataFrame:
    return R.ads_ratios(m.q07, m.q01, m.period("month").months, m.bridge)


@report("take_rate_series")
def _p25(m: Marts) -> DataFrame:
    return R.take_rate_series(m.q07, m.q01, m.bridge)


@report("catalog_table")
def _p31(m: Marts) -> DataFrame:
    return R.catalog_table(m.q10, m.bridge, m.portfolio)


@report("scorecard")
def _p32(m: Marts) -> DataFrame:
    return R.scorecard(m.q01, m.q02, m.q11, m.portfolio, m.as_of)


@report("reputation_table")
def _p33(m: Marts) -> DataFrame:
    return R.reputation_table(m.q11)


@report("visited_items_table")
def _p37(m: Marts) -> DataFrame:
    return R.visited_items_table(m.q14, m.q10, m.bridge, m.portfolio, k=50)


@report("campaign_seller_summary")
def _p38(m: Marts) -> DataFrame:
    return R.campaign_seller_summary(m.q16, m.bridge, m.portfolio)


@report("campaign_item_table")
def _p39(m: Marts) -> DataFrame:
    return R.campaign_item_table(m.q16, m.bridge, m.portfolio, k=500)


@report("price_kpi")
def _p40(m: Marts) -> DataFrame:
    return R.price_kpi(m.q15, m.bridge)


@report("price_seller_table")
def _p41(m: Marts) -> DataFrame:
    return R.price_seller_table(m.q15, m.bridge, m.portfolio)


@report("price_item_table")
def _p42(m: Marts) -> DataFrame:
    return R.price_item_table(m.q15, m.bridge, m.portfolio, k=200)


@report("price_item_table_k5")
def _p42_k5(m: Marts) -> DataFrame:
    """P42 with k = 5, so that the cut is exercised at small scale."""
    return R.price_item_table(m.q15, m.bridge, m.portfolio, k=5)


@report("qualification_table")
def _p43(m: Marts) -> DataFrame:
    return R.qualification_table(m.q15, m.bridge, m.portfolio)


@report("qualification_item_table")
def _p44(m: Marts) -> DataFrame:
    return R.price_item_table(m.q15, m.bridge, m.portfolio, k=300)


# ----------------------------------------------------------------------------- bundle
def _read_back(i: LogicalInputs, fmt: str) -> DataFrame:
    """The monthly sales mart, published as a bundle in the shared folder and read back from its current version."""
    from sellerlens.plans.bundle import current_bundle, publish

    frame = marts.sales_monthly(i.sales, AS_OF, i.portfolio)
    spark = frame.sparkSession
    out = f"{checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    publish(spark, {"sales_monthly": frame}, out, fmt=fmt, refreshed_at=REFRESHED_AT)
    schema = with_refresh_stamp(normalize(frame), REFRESHED_AT).schema
    return spark.read.schema(schema).format(fmt).load(current_bundle(spark, out)["sales_monthly"])


@register("bundle_parquet")
def _s04(i: LogicalInputs) -> DataFrame:
    return _read_back(i, "parquet")


@register("bundle_json")
def _s05(i: LogicalInputs) -> DataFrame:
    return _read_back(i, "json")


#: Reports that take no period.
PLAIN = {name: fn for name, fn in REPORTS.items() if name not in PERIOD_QUERIES}
