"""Marts: order-line and event facts rolled up per seller x day / month / item.

Every mart is one filter -> aggregate (-> window) plan over a logical input:
  * the date window is a literal range on the logical date column, which
    Catalyst unwraps into a pushed parquet filter;
  * the portfolio restriction is a left-semi join with a size-checked
    broadcast of the portfolio ids;
  * aggregation is hash-partitioned on (period, seller) with map-side partial
    aggregation, so a seller holding a third of all rows is combined locally
    before the shuffle and no single task receives its raw lines;
  * money stays DecimalType and is summed exactly, rounded once per mart row.

All functions take `as_of` explicitly (no wall clock) and return lazy frames.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions.dates import (
    DayWindow, last_days_window, last_months_window, since_window, two_year_window,
)
from sellerlens.functions.labels import DEAL_PRE_AGREED, FF_TYPES, HOME_SITE, SS_TYPES, XD_TYPES
from sellerlens.functions.ratios import rounded_money_ratio
from sellerlens.operators.scopes import (
    in_portfolio, in_portfolio_salted, keep_portfolio_sellers, portfolio_bound, split_portfolio,
)
from sellerlens.sources.schemas import require


def _sum2(col: Column | str, name: str) -> Column:
    """ROUND(SUM(x), 2) on exact decimals."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(F.sum(c), 2).alias(name)


def _sum_if(cond: Column, value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.sum(F.when(cond, v).otherwise(F.lit(0)))


def _countable_sales(sales: DataFrame, window: DayWindow,
                     portfolio: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Countable lines in the window; returns (rows, portfolio still to apply after aggregation)."""
    early, late = split_portfolio(portfolio)
    df = sales.where(F.col("gmv_flag") & window.predicate("closed_date"))
    return in_portfolio(df, early), late


def _site_rows(df: DataFrame, window: DayWindow, day_col: str, site: str,
               portfolio: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    early, late = split_portfolio(portfolio)
    df = df.where((F.col("site") == F.lit(site)) & window.predicate(day_col))
    return in_portfolio(df, early), late


def _month(col: str) -> Column:
    return F.trunc(F.col(col), "month").alias("month")


# --------------------------------------------------------------------------- sales measures
LOGISTIC_CLASSES = (("ff", FF_TYPES), ("xd", XD_TYPES), ("ss", SS_TYPES))
INVESTMENT_COLUMNS = (
    "g1_pre_agreed", "g1_dod", "g1_lightning", "g2_price_matching", "g2_smart", "g2_auto", "g3_coupons",
)
INVESTMENT_FAMILIES = {
    "g1": ("g1_pre_agreed", "g1_dod", "g1_lightning"),
    "g2": ("g2_price_matching", "g2_smart", "g2_auto"),
    "g3": ("g3_coupons",),
}
SALES_MEASURES = (
    "gmv", "si", *(f"{m}_{tag}" for tag, _ in LOGISTIC_CLASSES for m in ("gmv", "si")), *INVESTMENT_COLUMNS,
)


def sales_line_measures(pre_agreed_code: str = DEAL_PRE_AGREED) -> dict[str, Column]:
    """Every additive measure of the sales marts, as an expression on one order line.

    Q01-Q03 and Q05-Q08 are sums of these (money rounded once per mart row),
    so they can be summed from the lines directly or from `seller_day`.
    The investment rules are not exclusive: one line may count in up to
    three deal columns. Coupons count where the seller flag is FALSE only
    (a NULL flag takes the ELSE branch).
    """
    lt, gmv, units, zero = F.col("logistic_type"), F.col("gmv"), F.col("units"), F.lit(0)
    deal = F.coalesce(F.col("deal_invest"), zero)
    m = {"gmv": gmv, "si": units}
    for tag, types in LOGISTIC_CLASSES:
        m[f"gmv_{tag}"] = F.when(lt.isin(*types), gmv).otherwise(zero)
        m[f"si_{tag}"] = F.when(lt.isin(*types), units).otherwise(zero)
    m.update({
        "g1_pre_agreed": F.when(F.col("deal_subtype") == F.lit(pre_agreed_code), deal).otherwise(zero),
        "g1_dod": F.coalesce(F.col("dod_invest"), zero),
        "g1_lightning": F.coalesce(F.col("lightning_invest"), zero),
        "g2_price_matching": F.when(F.col("price_match_flag"), deal).otherwise(zero),
        "g2_smart": F.when(F.col("smart_flag"), deal).otherwise(zero),
        "g2_auto": F.coalesce(F.col("auto_invest"), zero),
        "g3_coupons": F.when(~F.col("coupon_by_seller_flag"), F.coalesce(F.col("coupon_amount"), zero))
        .otherwise(zero),
    })
    return m


def _sales_cols(s: dict[str, Column]) -> list[Column]:
    return [F.round(s["gmv"], 2).alias("gmv"), s["si"].alias("si")]


def _logistic_cols(s: dict[str, Column]) -> list[Column]:
    cols = [F.round(s["gmv"], 2).alias("gmv_total"), s["si"].alias("si_total")]
    for tag, _ in LOGISTIC_CLASSES:
        cols += [F.round(s[f"gmv_{tag}"], 2).alias(f"gmv_{tag}"), s[f"si_{tag}"].alias(f"si_{tag}")]
    return cols


def _investment_cols(s: dict[str, Column]) -> list[Column]:
    return [F.round(s[c], 2).alias(c) for c in INVESTMENT_COLUMNS]


def _gmv_investment_cols(s: dict[str, Column]) -> list[Column]:
    return [F.round(s["gmv"], 2).alias("gmv"), *_investment_cols(s)]


def _sales_mart(sales: DataFrame, window: DayWindow, portfolio: DataFrame | None, grain: str,
                cols, pre_agreed_code: str = DEAL_PRE_AGREED) -> DataFrame:
    """Countable lines in the window summed per (day or month, seller)."""
    df, late = _countable_sales(sales, window, portfolio)
    sums = {n: F.sum(e) for n, e in sales_line_measures(pre_agreed_code).items()}
    period = _month("closed_date") if grain == "month" else F.col("closed_date").alias("day")
    return keep_portfolio_sellers(df.groupBy(period, "seller_id").agg(*cols(sums)), late)


def seller_day(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
               pre_agreed_code: str = DEAL_PRE_AGREED, measures: tuple[str, ...] = SALES_MEASURES,
               window: DayWindow | None = None) -> DataFrame:
    """Shared daily mart: the sales measures per (day, seller) over the two-year window (or `window`), unrounded.

    The 90-day windows lie inside the two-year window, so one pass over the
    lines serves all six additive sales marts (`sales_marts_from_days`). With
    fewer `measures` the pass reads only the columns they need.
    """
    df, late = _countable_sales(sales, window or two_year_window(as_of), portfolio)
    m = {n: e for n, e in sales_line_measures(pre_agreed_code).items() if n in measures}
    agg = df.groupBy(F.col("closed_date").alias("day"), "seller_id").agg(*[F.sum(e).alias(n) for n, e in m.items()])
    return keep_portfolio_sellers(agg, late)


#: The marts that share measures, and those measures.
SALES_FAMILIES = {
    ("sales_monthly", "sales_daily"): ("gmv", "si"),
    ("logistics_monthly", "logistics_daily"): tuple(n for n in SALES_MEASURES if n not in INVESTMENT_COLUMNS),
    ("investments_monthly", "investments_daily"): ("gmv", *INVESTMENT_COLUMNS),
}


def sales_marts_from_days(days: DataFrame, as_of: dt.date, daily_days: int = 90) -> dict[str, DataFrame]:
    """Q01, Q02, Q03, Q05, Q06, Q08 rolled up from `seller_day` rows (decimal sums stay exact);
    the marts whose measures `days` has."""
    sums = {n: F.sum(n) for n in SALES_MEASURES}

    def roll(window: DayWindow, grain: str, cols) -> DataFrame:
        period = _month("day") if grain == "month" else F.col("day")
        return days.where(window.predicate("day")).groupBy(period, "seller_id").agg(*cols(sums))

    two_years, recent = two_year_window(as_of), last_days_window(as_of, daily_days)
    build = {
        "sales_monthly": lambda: roll(two_years, "month", _sales_cols).withColumn("asp", rounded_money_ratio("gmv", "si")),
        "sales_daily": lambda: roll(recent, "day", _sales_cols),
        "logistics_monthly": lambda: roll(two_years, "month", _logistic_cols),
        "logistics_daily": lambda: roll(recent, "day", _logistic_cols),
        "investments_monthly": lambda: roll(two_years, "month", _gmv_investment_cols),
        "investments_daily": lambda: roll(recent, "day", _investment_cols),
    }
    known = [name for names, needs in SALES_FAMILIES.items() if set(needs) <= set(days.columns) for name in names]
    return {name: build[name]() for name in known}


# --------------------------------------------------------------------------- Q01 / Q02
def sales_monthly(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None) -> DataFrame:
    """Q01: month, seller_id, gmv, si, asp over [Jan 1 last year, as_of)."""
    require(sales, ["seller_id", "closed_date", "gmv", "units", "gmv_flag"], "sales")
    agg = _sales_mart(sales, two_year_window(as_of), portfolio, "month", _sales_cols)
    return agg.withColumn("asp", rounded_money_ratio("gmv", "si"))


def sales_daily(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, days: int = 90) -> DataFrame:
    """Q02: day, seller_id, gmv, si over [as_of - 90, as_of)."""
    return _sales_mart(sales, last_days_window(as_of, days), portfolio, "day", _sales_cols)


# --------------------------------------------------------------------------- Q03 / Q06
def logistics_daily(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, days: int = 90) -> DataFrame:
    """Q03: gmv per logistic class per seller and day (plus units per class)."""
    require(sales, ["logistic_type"], "sales")
    return _sales_mart(sales, last_days_window(as_of, days), portfolio, "day", _logistic_cols)


def logistics_monthly(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None) -> DataFrame:
    """Q06: gmv and units per logistic class per seller and month."""
    return _sales_mart(sales, two_year_window(as_of), portfolio, "month", _logistic_cols)


# --------------------------------------------------------------------------- Q04 / Q07
def _ads_aggs() -> list[Column]:
    return [_sum2("cost", "ads_invest"), _sum2("attributed_gmv", "gmv_ads"), F.sum("clicks").alias("clicks")]


def ads_daily_mart(ads: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                   site: str = HOME_SITE, days: int = 90) -> DataFrame:
    """Q04: ads spend, attributed gmv, clicks per seller and day (home site)."""
    require(ads, ["seller_id", "day", "site", "cost", "attributed_gmv", "clicks"], "ads_daily")
    df, late = _site_rows(ads, last_days_window(as_of, days), "day", site, portfolio)
    return keep_portfolio_sellers(df.groupBy("day", "seller_id").agg(*_ads_aggs()), late)


def ads_monthly_mart(ads: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                     site: str = HOME_SITE) -> DataFrame:
    """Q07: as Q04 per month over the two-year window."""
    df, late = _site_rows(ads, two_year_window(as_of), "day", site, portfolio)
    return keep_portfolio_sellers(df.groupBy(_month("day"), "seller_id").agg(*_ads_aggs()), late)


def ads_day(ads: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, site: str = HOME_SITE) -> DataFrame:
    """Shared daily ads table: unrounded home-site sums per (day, seller) over the two-year window.

    Its columns keep the source names, so Q04 and Q07 roll up from it with the
    same aggregates (`ads_marts_from_days`): one read of the ads source for both.
    """
    df, late = _site_rows(ads, two_year_window(as_of), "day", site, portfolio)
    agg = df.groupBy("day", "seller_id").agg(*[F.sum(c).alias(c) for c in ("cost", "attributed_gmv", "clicks")])
    return keep_portfolio_sellers(agg, late)


def ads_marts_from_days(days: DataFrame, as_of: dt.date, daily_days: int = 90) -> dict[str, DataFrame]:
    """Q07 and Q04 rolled up from `ads_day` rows."""
    return {
        "ads_monthly": days.where(two_year_window(as_of).predicate("day"))
        .groupBy(_month("day"), "seller_id").agg(*_ads_aggs()),
        "ads_daily": days.where(last_days_window(as_of, daily_days).predicate("day"))
        .groupBy("day", "seller_id").agg(*_ads_aggs()),
    }


# --------------------------------------------------------------------------- Q05 / Q08
def investments_daily(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                      days: int = 90, pre_agreed_code: str = DEAL_PRE_AGREED) -> DataFrame:
    """Q05: the seven promotional-investment sums per seller and day."""
    return _sales_mart(sales, last_days_window(as_of, days), portfolio, "day", _investment_cols, pre_agreed_code)


def investments_monthly(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                        pre_agreed_code: str = DEAL_PRE_AGREED) -> DataFrame:
    """Q08: gmv and the seven investment sums per seller and month."""
    return _sales_mart(sales, two_year_window(as_of), portfolio, "month", _gmv_investment_cols, pre_agreed_code)


# --------------------------------------------------------------------------- Q09
def buybox_monthly(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None) -> DataFrame:
    """Q09: distinct orders (all / with a buy-box line), gmv and buy-box gmv.

    Exact distinct counts as two aggregation levels instead of two DISTINCT
    aggregates (which Catalyst would plan as an Expand doubling every line):
    first per (month, seller, order) - keyed by order, so a hot seller spreads
    over many tasks - then per (month, seller) counting the order rows.
    """
    require(sales, ["order_id", "buybox_flag"], "sales")
    df, late = _countable_sales(sales, two_year_window(as_of), portfolio)
    bb = F.col("buybox_flag")
    per_order = df.groupBy(_month("closed_date"), "seller_id", "order_id").agg(
        F.max(F.when(bb, F.lit(1)).otherwise(F.lit(0))).alias("_has_bb"),
        F.sum("gmv").alias("_gmv"),
        _sum_if(bb, "gmv").alias("_gmv_bb"),
    )
    return keep_portfolio_sellers(per_order.groupBy("month", "seller_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("_has_bb").cast("bigint").alias("orders_bb"),
        _sum2("_gmv", "gmv_total"),
        _sum2("_gmv_bb", "gmv_bb"),
    ), late)


# --------------------------------------------------------------------------- Q10
def top_items(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, k: int = 20,
              months: int = 3, titles: DataFrame | None = None) -> DataFrame:
    """Q10: top-k items per seller by gmv over [as_of - 3 months, as_of).

    Ranking is `row_number() <= k` over the (seller, item) aggregate, which
    Catalyst plans with a partial WindowGroupLimit before the shuffle by
    seller: at most k rows per seller leave each task. Ties break on item_id.
    Titles come from `titles` after ranking or, without it, as MAX(item_title)
    of the lines. The title table is first cut to the ranked items (at most k
    per seller, broadcast where the portfolio bounds them), so a large item
    dimension is neither shuffled whole nor able to fan rows out: one title,
    the greatest, per item.
    """
    df, late = _countable_sales(sales, last_months_window(as_of, months), portfolio)
    bb = F.col("buybox_flag")
    aggs = [F.sum("gmv").alias("_gmv"), F.sum("units").alias("si"), _sum_if(bb, "gmv").alias("_gmv_bb")]
    if titles is None:
        aggs.insert(0, F.max("item_title").alias("title"))
    agg = keep_portfolio_sellers(df.groupBy("seller_id", "item_id").agg(*aggs), late)
    w = Window.partitionBy("seller_id").orderBy(F.col("_gmv").desc(), F.col("item_id").asc())
    top = agg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    if titles is not None:
        top = top.join(ranked_titles(titles, top, portfolio_bound(portfolio, k)), "item_id", "left")
    return top.select(
        "seller_id", "item_id", "title",
        F.round("_gmv", 2).alias("gmv"), "si",
        rounded_money_ratio("_gmv", "si").alias("asp"),
        F.round("_gmv_bb", 2).alias("gmv_bb"),
        F.col("_rn").cast("bigint").alias("rank"),
    )


def ranked_titles(titles: DataFrame, top: DataFrame, few: bool) -> DataFrame:
    """(item_id, title) of the items in `top`, one row per item."""
    ids = top.select("item_id").distinct()
    wanted = titles.select("item_id", F.col("item_title").alias("title")).join(
        F.broadcast(ids) if few else ids, "item_id", "left_semi")
    one = wanted.groupBy("item_id").agg(F.max("title").alias("title"))
    return F.broadcast(one) if few else one


# --------------------------------------------------------------------------- Q11
def seller_reputation(reputation: DataFrame, portfolio: DataFrame | None = None, site: str = HOME_SITE) -> DataFrame:
    """Q11: reputation levels and rates (as percent, 2 dp) per seller."""
    require(reputation, ["seller_id", "site", "current_level", "real_level"], "reputation")
    df = in_portfolio(reputation.where(F.col("site") == F.lit(site)), portfolio)
    return df.select(
        "seller_id", "current_level", "real_level",
        F.round(F.col("claims_rate") * 100, 2).alias("claims_pct"),
        F.round(F.col("delayed_rate") * 100, 2).alias("delay_pct"),
        F.round(F.col("cancel_rate") * 100, 2).alias("cancel_pct"),
        F.round("tx_3m").cast("bigint").alias("orders_3m"),
    )


# --------------------------------------------------------------------------- Q12 / Q13 / Q14
def visits_monthly(visits: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                   site: str = HOME_SITE) -> DataFrame:
    """Q12: page views and VIP page views per seller and month."""
    require(visits, ["seller_id", "item_id", "day", "site", "pageviews", "pageviews_vip", "visits"], "visits")
    df, late = _site_rows(visits, two_year_window(as_of), "day", site, portfolio)
    return keep_portfolio_sellers(df.groupBy(_month("day"), "seller_id").agg(
        F.sum("pageviews").alias("visits"), F.sum("pageviews_vip").alias("visits_vip")
    ), late)


def visits_daily(visits: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                 site: str = HOME_SITE, days: int = 90) -> DataFrame:
    """Q13: page views per seller and day."""
    df, late = _site_rows(visits, last_days_window(as_of, days), "day", site, portfolio)
    agg = df.groupBy("day", "seller_id").agg(F.sum("pageviews").alias("visits"))
    return keep_portfolio_sellers(agg, late)


def visits_day(visits: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
               site: str = HOME_SITE) -> DataFrame:
    """Shared daily visits table: home-site page views per (day, seller) over the two-year window."""
    df, late = _site_rows(visits, two_year_window(as_of), "day", site, portfolio)
    agg = df.groupBy("day", "seller_id").agg(*[F.sum(c).alias(c) for c in ("pageviews", "pageviews_vip")])
    return keep_portfolio_sellers(agg, late)


def visits_marts_from_days(days: DataFrame, as_of: dt.date, daily_days: int = 90) -> dict[str, DataFrame]:
    """Q12 and Q13 rolled up from `visits_day` rows."""
    return {
        "visits_monthly": days.where(two_year_window(as_of).predicate("day")).groupBy(_month("day"), "seller_id")
        .agg(F.sum("pageviews").alias("visits"), F.sum("pageviews_vip").alias("visits_vip")),
        "visits_daily": days.where(last_days_window(as_of, daily_days).predicate("day"))
        .groupBy("day", "seller_id").agg(F.sum("pageviews").alias("visits")),
    }


def top_items_by_visits(visits: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, k: int = 50,
                        site: str = HOME_SITE, days: int = 90) -> DataFrame:
    """Q14: top-k items per seller, ranked by SUM(visits) but showing SUM(pageviews)."""
    df, late = _site_rows(visits, last_days_window(as_of, days), "day", site, portfolio)
    agg = keep_portfolio_sellers(df.groupBy("seller_id", "item_id").agg(
        F.sum("pageviews").alias("visits"), F.sum("pageviews_vip").alias("visits_vip"),
        F.sum("visits").alias("_rank_metric"),
    ), late)
    w = Window.partitionBy("seller_id").orderBy(F.col("_rank_metric").desc(), F.col("item_id").asc())
    return (
        agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .select("seller_id", "item_id", "visits", "visits_vip", F.col("rank").cast("bigint").alias("rank"))
    )


# --------------------------------------------------------------------------- Q16
def campaign_items(optin: DataFrame, eligible: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None,
                   site: str = HOME_SITE, days: int = 2, limit: int | None = None,
                   candidates_only: bool = True) -> DataFrame:
    """Q16: campaign opt-in rows with eligibility prices, newest first per seller.

    Left join on (campaign, item); eligible-side duplicates fan out. The sort is
    the reference's five keys completed to a total order by the other output
    columns. All rows by default; `limit` cuts them to the reference's own number (a
    global top-k: TakeOrderedAndProject keeps `limit` rows per task before one
    final merge), which keeps the first sellers only, so reports never use it.
    """
    require(optin, ["promotion_id", "item_id", "seller_id", "type", "day", "site", "candidate_flag",
                    "offer_flag", "gmv_l30d"], "campaign_optin")
    o, late = _site_rows(optin, since_window(as_of, days), "day", site, portfolio)
    # Row level: there is no aggregate to filter after. A large portfolio meets the rows by (seller, salt).
    o = in_portfolio_salted(o, late, "item_id")
    if candidates_only:
        o = o.where(F.col("candidate_flag"))
    e = eligible.select(
        F.col("campaign_id").alias("promotion_id"), "item_id",
        F.round("first_price", 2).alias("price_initial"),
        F.round("tag_price", 2).alias("price_final"),
        F.col("status"),
    )
    joined = o.join(e, ["promotion_id", "item_id"], "left").select(
        "type", "day", "seller_id", "item_id",
        F.col("candidate_flag").alias("eligible"), F.col("offer_flag").alias("opt_in"),
        "price_initial", "price_final", "status",
        F.round("gmv_l30d", 2).alias("gmv_l30d"),
    )
    if limit is None:
        return joined
    order = [
        F.col("seller_id").asc(), F.col("day").desc(), F.col("opt_in").desc_nulls_last(),
        F.col("type").asc_nulls_first(), F.col("item_id").asc(),
        F.col("eligible").asc_nulls_first(), F.col("price_initial").asc_nulls_first(),
        F.col("price_final").asc_nulls_first(), F.col("status").asc_nulls_first(),
        F.col("gmv_l30d").asc_nulls_first(),
    ]
    return joined.orderBy(*order).limit(limit)
