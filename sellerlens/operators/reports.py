"""Report tables and series over marts (P18-P45), for every scope at once.

Conventions kept from the reference report:
  * value fields: an undefined ratio is 0 (`ratio_or_zero`); delta and series
    fields: it is NULL;
  * daily periods read each metric's own daily mart (the reference read a
    month list no daily period sets, or always the sales mart);
  * percentages and ratios are unrounded doubles of exact sums (display
    rounding is presentation); money stays decimal until the output edge.

Scale notes: per-scope totals are joined back through `attach_per_scope`,
which broadcasts the totals only when their row count is proven small (one
row per scope), else shuffles (AQE splits the hot "all" scope). Per-scope
top-k uses `row_number() <= k`, planned with a partial WindowGroupLimit so a
hot scope sends at most k rows per task into its final window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions import labels as L
from sellerlens.functions.calendar import Period
from sellerlens.functions.ratios import pct, pct_change, pct_or_zero, ratio, ratio_or_zero
from sellerlens.operators import measures as M
from sellerlens.operators.marts import INVESTMENT_FAMILIES
from sellerlens.operators.price import price_order
from sellerlens.operators.scopes import seller_label
from sellerlens.plans.broadcast import broadcast_if_bounded, is_small

DEFAULT_ITEM_URL = "https://items.example/HOME-"
#: Parts that a scope's rows are ranked in before they meet.
TOP_SALTS = 64


def attach_per_scope(df: DataFrame, per_scope: DataFrame, bridge: DataFrame) -> DataFrame:
    """Join one-row-per-scope values back; broadcast when the scope bridge is small."""
    return df.join(broadcast_if_bounded(per_scope, bridge), "scope")


#: Parts that a scope's sellers are ranked in where the portfolio isn't proven small.
RANK_PARTS = 256


def ranked(rows: DataFrame, by: str, bridge: DataFrame) -> DataFrame:
    """`rows` (one per scope and seller) with their `rank` in the scope: `by` descending, then seller id.

    A portfolio proven small is ranked in one window per scope. A larger one is cut at the scope's percentiles of
    `by`: a row's rank is the number of rows in the parts above its own plus its place in that part.
    """
    order = [F.col(by).desc_nulls_last(), F.col("seller_id").asc()]
    if is_small(bridge):
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(*order)).cast("bigint"))
    value = F.coalesce(F.col(by).cast("double"), F.lit(float("-inf")))
    at = F.array(*[F.lit(k / RANK_PARTS) for k in range(1, RANK_PARTS)])
    cuts = rows.groupBy("scope").agg(F.percentile_approx(value, at, F.lit(100 * RANK_PARTS)).alias("_cuts"))
    parted = attach_per_scope(rows, cuts, bridge).withColumn("_part", F.size(F.filter("_cuts", lambda c: c > value))).drop("_cuts")
    above = Window.partitionBy("scope").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("scope", "_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("scope", "_part", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    place = F.row_number().over(Window.partitionBy("scope", "_part").orderBy(*order))
    return parted.join(sizes, ["scope", "_part"]).withColumn("rank", (F.col("_above") + place).cast("bigint")).drop("_part", "_above")


def _mart_for(period: Period, monthly: DataFrame, daily: DataFrame) -> DataFrame:
    return daily if period.daily else monthly


def _fam(f: str) -> Column:
    cols = [F.coalesce(F.col(c), F.lit(0)) for c in INVESTMENT_FAMILIES[f]]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


# ----------------------------------------------------------------------------- P18 sales
def seller_sales_table(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame,
                       portfolio: DataFrame) -> DataFrame:
    """Per scope and seller: gmv, si, asp (0 without units), share of the scope's gmv."""
    per = M.rollup_sellers(_mart_for(period, monthly, daily), ["gmv", "si"], bridge, period)
    tot = per.groupBy("scope").agg(F.sum("gmv").alias("_tg"))
    out = attach_per_scope(per, tot, bridge).select(
        "scope", "seller_id", "gmv", "si",
        ratio_or_zero("gmv", "si").alias("asp"),
        pct_or_zero("gmv", "_tg").alias("share_pct"),
    )
    return seller_label(ranked(out, "gmv", bridge), portfolio)


# ----------------------------------------------------------------------------- P19-P21 logistics
LOGISTIC_GMV = ("gmv_total", "gmv_ff", "gmv_xd", "gmv_ss")


def logistics_mix(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """% of gmv per class over the period (a zero total divides by 1), gmv_ff with deltas."""
    k = M.kpi_delta(monthly, daily, list(LOGISTIC_GMV), period, bridge)
    total = F.when(F.col("gmv_total") != 0, F.col("gmv_total")).otherwise(F.lit(1))
    return k.select(
        "scope",
        *[pct(c, total).alias(f"{c[4:]}_pct") for c in ("gmv_ff", "gmv_xd", "gmv_ss")],
        "gmv_ff", "gmv_ff_d1", "gmv_ff_d2",
    )


def logistics_series(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """P20: per day (days with rows) or chart month (zero-filled): %FF, gmv and units per class."""
    fields = list(LOGISTIC_GMV) + ["si_ff", "si_xd", "si_ss"]
    if period.chart_daily:
        s, e = period.chart_days
        ser = M.daily_series(daily, fields, s, e, bridge)
        label = F.col("day").cast("string")
    else:
        ser = M.monthly_series(monthly, fields, period.chart_months, bridge)
        label = F.date_format("month", "yyyy-MM")
    return ser.select(
        "scope", label.alias("label"), pct("gmv_ff", "gmv_total").alias("ff_pct"),
        "gmv_ff", "gmv_xd", "gmv_ss", "si_ff", "si_xd", "si_ss",
    )


def logistics_seller_table(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame,
                           portfolio: DataFrame) -> DataFrame:
    """Per seller gmv and share per class (0 on a zero total); flag FF >= 50%."""
    per = M.rollup_sellers(_mart_for(period, monthly, daily), list(LOGISTIC_GMV), bridge, period)
    out = per.select(
        "scope", "seller_id", "gmv_total",
        "gmv_ff", pct_or_zero("gmv_ff", "gmv_total").alias("ff_pct"),
        "gmv_xd", pct_or_zero("gmv_xd", "gmv_total").alias("xd_pct"),
        "gmv_ss", pct_or_zero("gmv_ss", "gmv_total").alias("ss_pct"),
    )
    out = ranked(out, "gmv_total", bridge)
    return seller_label(out.withColumn("ff_flag", F.col("ff_pct") >= F.lit(L.FF_SHARE_FLAG)), portfolio)


# ----------------------------------------------------------------------------- P22-P26 ads
ADS_FIELDS = ("ads_invest", "gmv_ads", "clicks")


def previous_present_month(ads_monthly: DataFrame, bridge: DataFrame, month: dt.date | None) -> DataFrame:
    """(scope, prev_month): the ads month present before `month`, if `month` is present."""
    if month is None:
        return M.scope_list(bridge).select("scope", F.lit(None).cast("date").alias("prev_month"))
    present = M.scoped(ads_monthly.select("seller_id", "month"), bridge).select("scope", "month").distinct()
    before = present.where(F.col("month") < F.lit(month)).groupBy("scope").agg(F.max("month").alias("_p"))
    has = present.where(F.col("month") == F.lit(month)).select("scope")
    prev = has.join(before, "scope", "left").select("scope", F.col("_p").alias("prev_month"))
    return M.scope_list(bridge).join(prev, "scope", "left")


def _take_rate(spend: str, prev_gmv: str) -> Column:
    return F.when(F.col(prev_gmv) != 0, F.col(spend).cast("double") / F.col(prev_gmv).cast("double") * 100.0)


def ads_role_metrics(ads_monthly: DataFrame, sales_monthly: DataFrame, roles: dict[str, list | tuple],
                     bridge: DataFrame) -> DataFrame:
    """Ads sums and ratios for several month sets (roles) in one pass over each mart.

    Both marts are rolled up once per (scope, month); the previous *present*
    ads month (and its sales gmv) comes from a `lag` over each scope's ads
    months (at most a few dozen rows per scope); every role is then a set of
    conditional sums in one aggregation. Output per role r: ads_invest_r,
    gmv_ads_r, gmv_r, roas_r, acos_r, ads_share_r, take_rate_r.
    """
    ads = M.rollup_months(ads_monthly, ["ads_invest", "gmv_ads"], bridge)
    gmv = M.rollup_months(sales_monthly, ["gmv"], bridge)
    ads = ads.withColumn("prev_month", F.lag("month").over(Window.partitionBy("scope").orderBy("month")))
    ads = ads.join(gmv.select("scope", F.col("month").alias("prev_month"), F.col("gmv").alias("prev_gmv")),
                   ["scope", "prev_month"], "left")
    a_aggs, g_aggs = [], []
    for role, months in roles.items():
        months = list(months or ())
        in_m = F.col("month").isin(months) if months else F.lit(False)
        a_aggs += [F.sum(F.when(in_m, F.col("ads_invest")).otherwise(F.lit(0))).alias(f"_inv_{role}"),
                   F.sum(F.when(in_m, F.col("gmv_ads")).otherwise(F.lit(0))).alias(f"_gads_{role}")]
        last = F.col("month") == F.lit(months[-1]) if months else F.lit(False)
        a_aggs.append(F.max(F.when(last, F.col("prev_gmv"))).alias(f"_pg_{role}"))
        g_aggs.append(F.sum(F.when(in_m, F.col("gmv")).otherwise(F.lit(0))).alias(f"_gmv_{role}"))
    t = M.scope_list(bridge).join(ads.groupBy("scope").agg(*a_aggs), "scope", "left").join(
        gmv.groupBy("scope").agg(*g_aggs), "scope", "left")
    out = [F.col("scope")]
    for role in roles:
        inv, gads, gm = (F.coalesce(F.col(f"_{c}_{role}"), F.lit(0)) for c in ("inv", "gads", "gmv"))
        out += [
            inv.alias(f"ads_invest_{role}"), gads.alias(f"gmv_ads_{role}"), gm.alias(f"gmv_{role}"),
            ratio_or_zero(gads, inv).alias(f"roas_{role}"),
            pct_or_zero(inv, gads).alias(f"acos_{role}"),
            pct_or_zero(gads, gm).alias(f"ads_share_{role}"),
            F.when(F.col(f"_pg_{role}") != 0,
                   inv.cast("double") / F.col(f"_pg_{role}").cast("double") * 100.0).alias(f"take_rate_{role}"),
        ]
    return t.select(*out)


ADS_RATIO_COLUMNS = ("ads_invest", "gmv_ads", "gmv", "roas", "acos", "ads_share", "take_rate")


def ads_ratios(ads_monthly: DataFrame, sales_monthly: DataFrame, months: list[dt.date] | tuple,
               bridge: DataFrame) -> DataFrame:
    """ROAS, ACOS %, ads share of gmv % (0 when undefined) and take rate %
    (spend over the gmv of the previous present ads month; NULL without one).
    """
    t = ads_role_metrics(ads_monthly, sales_monthly, {"c": months}, bridge)
    return t.select("scope", *[F.col(f"{c}_c").alias(c) for c in ADS_RATIO_COLUMNS])


def _daily_ads_ratios(ads_daily: DataFrame, sales_daily: DataFrame, rng: tuple, bridge: DataFrame) -> DataFrame:
    ads = M.sum_daily_range(ads_daily, ["ads_invest", "gmv_ads"], rng[0], rng[1], bridge)
    gmv = M.sum_daily_range(sales_daily, ["gmv"], rng[0], rng[1], bridge)
    return ads.join(gmv, "scope").select(
        "scope", "ads_invest", "gmv_ads", "gmv",
        ratio_or_zero("gmv_ads", "ads_invest").alias("roas"),
        pct_or_zero("ads_invest", "gmv_ads").alias("acos"),
        pct_or_zero("gmv_ads", "gmv").alias("ads_share"),
        F.lit(None).cast("double").alias("take_rate"),
    )


RATIO_METRICS = ("roas", "acos", "ads_share", "take_rate")


def _ratio_delta(m: str, role: str, has_role: bool) -> Column:
    """Absolute difference to the comparison ratio; a NULL current value counts as 0."""
    if not has_role:
        return F.lit(None).cast("double").alias(f"{m}_{role}")
    prior = F.col(f"{m}_{role}")
    return F.when(prior.isNotNull(), F.coalesce(F.col(f"{m}_curr"), F.lit(0.0)) - prior).alias(f"{m}_{role}")


def ads_kpi(ads_monthly: DataFrame, ads_daily: DataFrame, sales_monthly: DataFrame, sales_daily: DataFrame,
            period: Period, bridge: DataFrame) -> DataFrame:
    """Spend and ads gmv with % deltas; ratios with absolute-difference deltas.

    A ratio delta exists only when the comparison ratio exists; a NULL current
    ratio counts as 0 in the difference. ACOS improves downwards (acos_better_down).
    """
    if period.daily:
        k = M.kpi_delta(ads_monthly, ads_daily, ["ads_invest", "gmv_ads"], period, bridge)
        cur = _daily_ads_ratios(ads_daily, sales_daily, period.days, bridge)
        t = k.join(cur.select("scope", *RATIO_METRICS), "scope")
        nulls = [F.lit(None).cast("double").alias(f"{m}_{r}") for m in RATIO_METRICS for r in ("d1", "d2")]
        return t.select(*k.columns, *RATIO_METRICS, *nulls, F.lit(True).alias("acos_better_down"))
    roles = {"curr": period.months}
    if period.months_before:
        roles["d1"] = period.months_before
    if period.months_last_year:
        roles["d2"] = period.months_last_year
    t = ads_role_metrics(ads_monthly, sales_monthly, roles, bridge)
    out = [F.col("scope")]
    for f in ("ads_invest", "gmv_ads"):
        out.append(F.col(f"{f}_curr").alias(f))
        for r in ("d1", "d2"):
            delta = pct_change(f"{f}_curr", f"{f}_{r}") if r in roles else F.lit(None).cast("double")
            out.append(delta.alias(f"{f}_{r}"))
    out += [F.col(f"{m}_curr").alias(m) for m in RATIO_METRICS]
    out += [_ratio_delta(m, r, r in roles) for m in RATIO_METRICS for r in ("d1", "d2")]
    return t.select(*out, F.lit(True).alias("acos_better_down"))


def ads_series(ads_monthly: DataFrame, ads_daily: DataFrame, sales_monthly: DataFrame, sales_daily: DataFrame,
               period: Period, bridge: DataFrame) -> DataFrame:
    """Per chart day (ads days with rows) or chart month (zero-filled):
    spend, ads gmv, ROAS, ACOS %, ads share % (NULL when undefined)."""
    if period.chart_daily:
        s, e = period.chart_days
        ads = M.daily_series(ads_daily, ["ads_invest", "gmv_ads"], s, e, bridge)
        gmv = M.daily_series(sales_daily, ["gmv"], s, e, bridge)
        t = ads.join(gmv, ["scope", "day"], "left")
        label = F.col("day").cast("string")
    else:
        ads = M.monthly_series(ads_monthly, ["ads_invest", "gmv_ads"], period.chart_months, bridge)
        gmv = M.monthly_series(sales_monthly, ["gmv"], period.chart_months, bridge)
        t = ads.join(gmv, ["scope", "month"], "left")
        label = F.date_format("month", "yyyy-MM")
    return t.select(
        "scope", label.alias("label"), "ads_invest", "gmv_ads",
        ratio("gmv_ads", "ads_invest").alias("roas"),
        pct("ads_invest", "gmv_ads").alias("acos"),
        pct("gmv_ads", F.coalesce(F.col("gmv"), F.lit(0))).alias("ads_share"),
    )


def take_rate_series(ads_monthly: DataFrame, sales_monthly: DataFrame, bridge: DataFrame) -> DataFrame:
    """P25: every present ads month: spend / gmv of the previous present ads month (%)."""
    ads = M.rollup_months(ads_monthly, ["ads_invest"], bridge)
    w = Window.partitionBy("scope").orderBy("month")
    ads = ads.withColumn("prev_month", F.lag("month").over(w))
    gmv = M.rollup_months(sales_monthly, ["gmv"], bridge).select(
        "scope", F.col("month").alias("prev_month"), F.col("gmv").alias("_pg")
    )
    t = ads.join(gmv, ["scope", "prev_month"], "left")
    return t.select("scope", "month", "ads_invest", _take_rate("ads_invest", "_pg").alias("take_rate"))


def ads_seller_table(ads_monthly: DataFrame, ads_daily: DataFrame, sales_monthly: DataFrame,
                     sales_daily: DataFrame, period: Period, bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller: spend, ads gmv, clicks, ROAS, ACOS %, take rate %, ads share %."""
    per = M.rollup_sellers(_mart_for(period, ads_monthly, ads_daily), list(ADS_FIELDS), bridge, period)
    gmv = M.rollup_sellers(_mart_for(period, sales_monthly, sales_daily), ["gmv"], bridge, period)
    t = per.join(gmv, ["scope", "seller_id"], "left")
    if period.daily:
        t = t.withColumn("_pg", F.lit(None).cast("decimal(38,2)"))
    else:
        prev = previous_present_month(ads_monthly, bridge, period.last_month)
        pg = M.scoped(sales_monthly.select("seller_id", "month", "gmv"), bridge).select(
            "scope", "seller_id", F.col("month").alias("prev_month"), F.col("gmv").alias("_pg")
        )
        t = attach_per_scope(t, prev, bridge).join(pg, ["scope", "seller_id", "prev_month"], "left")
    out = t.select(
        "scope", "seller_id", "ads_invest", "gmv_ads", "clicks",
        ratio_or_zero("gmv_ads", "ads_invest").alias("roas"),
        pct_or_zero("ads_invest", "gmv_ads").alias("acos"),
        _take_rate("ads_invest", "_pg").alias("take_rate"),
        pct_or_zero("gmv_ads", F.coalesce(F.col("gmv"), F.lit(0))).alias("ads_share"),
    )
    return seller_label(ranked(out, "ads_invest", bridge), portfolio)


# ----------------------------------------------------------------------------- P27-P30 investments
def investment_totals(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """Per scope the three investment families and their total over the period."""
    from sellerlens.operators.marts import INVESTMENT_COLUMNS

    cols = list(INVESTMENT_COLUMNS)
    if period.daily:
        s = M.sum_daily_range(daily, cols, *period.days, bridge)
    else:
        s = M.sum_months(monthly, cols, period.months, bridge)
    s = s.select("scope", _fam("g1").alias("g1"), _fam("g2").alias("g2"), _fam("g3").alias("g3"))
    return s.withColumn("total", F.col("g1") + F.col("g2") + F.col("g3"))


def investment_mix(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """(scope, family, amount) for coupons (g3), commercial (g1), promo centre (g2)."""
    t = investment_totals(monthly, daily, period, bridge)
    return t.select("scope", F.expr("stack(3, 'g3', g3, 'g1', g1, 'g2', g2) AS (family, amount)"))


def investment_series(monthly: DataFrame, daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """Per chart day (with rows) or chart month (zero-filled): g1, g2, g3."""
    from sellerlens.operators.marts import INVESTMENT_COLUMNS

    cols = list(INVESTMENT_COLUMNS)
    if period.chart_daily:
        s, e = period.chart_days
        ser = M.daily_series(daily, cols, s, e, bridge)
        label = F.col("day").cast("string")
    else:
        ser = M.monthly_series(monthly, cols, period.chart_months, bridge)
        label = F.date_format("month", "yyyy-MM")
    return ser.select("scope", label.alias("label"), _fam("g1").alias("g1"), _fam("g2").alias("g2"),
                      _fam("g3").alias("g3"))


def investment_seller_table(monthly: DataFrame, daily: DataFrame, sales_daily: DataFrame, period: Period,
                            bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller gmv, families, total and total / gmv % (0 without gmv)."""
    from sellerlens.operators.marts import INVESTMENT_COLUMNS

    cols = list(INVESTMENT_COLUMNS)
    if period.daily:
        per = M.rollup_sellers(daily, cols, bridge, period)
        per = per.join(M.rollup_sellers(sales_daily, ["gmv"], bridge, period), ["scope", "seller_id"], "left")
    else:
        per = M.rollup_sellers(monthly, ["gmv"] + cols, bridge, period)
    t = per.select("scope", "seller_id", F.coalesce(F.col("gmv"), F.lit(0)).alias("gmv"),
                   _fam("g1").alias("g1"), _fam("g2").alias("g2"), _fam("g3").alias("g3"))
    t = t.withColumn("total", F.col("g1") + F.col("g2") + F.col("g3"))
    t = ranked(t, "total", bridge)
    return seller_label(t.withColumn("invest_pct", pct_or_zero("total", "gmv")), portfolio)


# ----------------------------------------------------------------------------- P31 catalog
def item_url(item_id: str | Column = "item_id", prefix: str = DEFAULT_ITEM_URL) -> Column:
    """Constant prefix + item id."""
    c = F.col(item_id) if isinstance(item_id, str) else item_id
    return F.concat(F.lit(prefix), c.cast("string"))


def catalog_table(top: DataFrame, bridge: DataFrame, portfolio: DataFrame, url_prefix: str = DEFAULT_ITEM_URL) -> DataFrame:
    """Listed top items of the scope's sellers with share of the listed gmv,
    buy-box % of gmv (0 without gmv), flag >= 50% and item link."""
    rows = M.scoped(top, bridge)
    tot = rows.groupBy("scope").agg(F.sum("gmv").alias("_tg"))
    t = attach_per_scope(rows, tot, bridge)
    bb = pct_or_zero("gmv_bb", "gmv")
    out = t.select(
        "scope", "seller_id", "item_id", F.coalesce(F.col("title"), F.lit("")).alias("title"),
        "gmv", "si", "asp", pct_or_zero("gmv", "_tg").alias("share_pct"), "gmv_bb",
        bb.alias("bb_pct"), (bb >= F.lit(L.BUYBOX_SHARE_FLAG)).alias("bb_flag"),
        item_url("item_id", url_prefix).alias("item_url"),
    )
    return seller_label(out, portfolio)


# ----------------------------------------------------------------------------- P32 / P33 scorecard
def reputation_class(level: str | Column) -> Column:
    """Level -> class (missing level counts as green)."""
    lv = F.col(level) if isinstance(level, str) else level
    return (
        F.when(lv.isNull() | (lv == ""), F.lit("green"))
        .when(lv.contains("platinum"), F.lit("platinum"))
        .when(lv.contains("gold"), F.lit("gold"))
        .when(lv == "green", F.lit("green"))
        .when(lv == "yellow", F.lit("yellow"))
        .when(lv == "orange", F.lit("orange"))
        .otherwise(F.lit("red"))
    )


def reputation_label(level: str | Column) -> Column:
    """Level -> display label; unknown keeps the level, missing is '-'."""
    lv = F.col(level) if isinstance(level, str) else level
    mapped = L.map_lookup(lv, L.REPUTATION_LABELS)
    return F.coalesce(mapped, F.when(lv != "", lv), F.lit("-"))


def reputation_table(rep: DataFrame) -> DataFrame:
    """Q11 rows with their P33 class and label."""
    return rep.select("*", reputation_class("current_level").alias("rep_class"),
                      reputation_label("current_level").alias("rep_label"))


def scorecard(sales_monthly: DataFrame, sales_daily: DataFrame, rep: DataFrame, portfolio: DataFrame,
              as_of: dt.date) -> DataFrame:
    """Per portfolio seller: current-month gmv and ASP, WoW / MoM / YoY % and
    reputation (level class/label and rates); one conditional aggregation per mart."""
    from sellerlens.functions.dates import add_months, month_start

    cm = month_start(as_of)
    pm, ym = add_months(cm, -1), add_months(cm, -12)
    one = dt.timedelta(days=1)
    w1 = (as_of - 7 * one, as_of - one)
    w2 = (as_of - 14 * one, as_of - 8 * one)
    month = F.col("month")
    m = sales_monthly.where(month.isin(cm, pm, ym)).groupBy("seller_id").agg(
        F.sum(F.when(month == F.lit(cm), F.col("gmv")).otherwise(F.lit(0))).alias("gmv"),
        F.sum(F.when(month == F.lit(cm), F.col("si")).otherwise(F.lit(0))).alias("si"),
        F.sum(F.when(month == F.lit(pm), F.col("gmv")).otherwise(F.lit(0))).alias("_pm"),
        F.sum(F.when(month == F.lit(ym), F.col("gmv")).otherwise(F.lit(0))).alias("_ym"),
    )
    day = F.col("day")
    d = sales_daily.where(day.between(F.lit(w2[0]), F.lit(w1[1]))).groupBy("seller_id").agg(
        F.sum(F.when(day.between(F.lit(w1[0]), F.lit(w1[1])), F.col("gmv")).otherwise(F.lit(0))).alias("_w1"),
        F.sum(F.when(day.between(F.lit(w2[0]), F.lit(w2[1])), F.col("gmv")).otherwise(F.lit(0))).alias("_w2"),
    )
    base = portfolio.groupBy("seller_id").agg(F.min("name").alias("name"))
    t = base.join(m, "seller_id", "left").join(d, "seller_id", "left").join(rep, "seller_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return t.select(
        "seller_id", "name",
        z("gmv").alias("gmv"), z("si").alias("si"),
        ratio_or_zero(z("gmv"), z("si")).alias("asp"),
        pct_change(z("_w1"), z("_w2")).alias("wow_pct"),
        pct_change(z("gmv"), z("_pm")).alias("mom_pct"),
        pct_change(z("gmv"), z("_ym")).alias("yoy_pct"),
        "current_level",
        reputation_class("current_level").alias("rep_class"),
        reputation_label("current_level").alias("rep_label"),
        "claims_pct", "delay_pct", "cancel_pct",
    )


# ----------------------------------------------------------------------------- P34-P37 visits
def visit_kpi(visits_monthly: DataFrame, visits_daily: DataFrame, sales_monthly: DataFrame,
              sales_daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """Visits with deltas, units, and units per visit % (0 without visits)."""
    k = M.kpi_delta(visits_monthly, visits_daily, ["visits"], period, bridge)
    if period.daily:
        u = M.sum_daily_range(sales_daily, ["si"], *period.days, bridge)
    else:
        u = M.sum_months(sales_monthly, ["si"], period.months, bridge)
    t = k.join(u, "scope")
    return t.select("scope", "visits", "visits_d1", "visits_d2", F.col("si").alias("units"),
                    pct_or_zero("si", "visits").alias("units_per_visit_pct"))


def conversion_series(visits_monthly: DataFrame, visits_daily: DataFrame, sales_monthly: DataFrame,
                      sales_daily: DataFrame, period: Period, bridge: DataFrame) -> DataFrame:
    """Visits and units per visit % (NULL without visits) per period month
    (zero-filled) or, in daily modes, per chart day with visit rows."""
    if period.daily:
        s, e = period.chart_days
        v = M.daily_series(visits_daily, ["visits"], s, e, bridge)
        u = M.daily_series(sales_daily, ["si"], s, e, bridge)
        t = v.join(u, ["scope", "day"], "left")
        label = F.col("day").cast("string")
    else:
        months = period.months if period.chart_daily else period.chart_months
        v = M.monthly_series(visits_monthly, ["visits"], months, bridge)
        u = M.monthly_series(sales_monthly, ["si"], months, bridge)
        t = v.join(u, ["scope", "month"], "left")
        label = F.date_format("month", "yyyy-MM")
    return t.select("scope", label.alias("label"), "visits",
                    pct(F.coalesce(F.col("si"), F.lit(0)), "visits").alias("units_per_visit_pct"))


def visits_seller_table(visits_monthly: DataFrame, visits_daily: DataFrame, sales_monthly: DataFrame,
                        sales_daily: DataFrame, period: Period, bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller visits, VIP visits, units and units per visit %."""
    if period.daily:
        v = M.rollup_sellers(visits_daily.withColumn("visits_vip", F.lit(0).cast("bigint")),
                             ["visits", "visits_vip"], bridge, period)
        u = M.rollup_sellers(sales_daily, ["si"], bridge, period)
    else:
        v = M.rollup_sellers(visits_monthly, ["visits", "visits_vip"], bridge, period)
        u = M.rollup_sellers(sales_monthly, ["si"], bridge, period)
    t = v.join(u, ["scope", "seller_id"], "left")
    units = F.coalesce(F.col("si"), F.lit(0))
    out = t.select("scope", "seller_id", "visits", "visits_vip", units.alias("units"),
                   pct_or_zero(units, "visits").alias("units_per_visit_pct"))
    return seller_label(ranked(out, "visits", bridge), portfolio)


def top_per_scope(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each scope with their rank, in two levels.

    The scope "all" takes part of every seller's rows, so the rows of a scope are first cut to k in each
    of the salts its sellers fall into (all their partial limits stay map-side), and the few winners meet then.
    """
    salt = F.pmod(F.xxhash64("seller_id"), F.lit(TOP_SALTS))
    first = Window.partitionBy("scope", "_salt").orderBy(*order)
    few = rows.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    last = Window.partitionBy("scope").orderBy(*order)
    return few.drop("_salt", "_r").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)


def visited_items_table(top_visited: DataFrame, top_sold: DataFrame, bridge: DataFrame, portfolio: DataFrame,
                        k: int = 50) -> DataFrame:
    """The scope's k most visited items (shown visits desc), with title and
    units of the top-selling items (missing: '' and 0) and units per visit %."""
    v = M.scoped(top_visited.select("seller_id", "item_id", "visits"), bridge)
    v = top_per_scope(v, [F.col("visits").desc(), F.col("seller_id"), F.col("item_id")], k)
    sold = top_sold.select("seller_id", "item_id", "title", "si")
    t = v.join(sold, ["seller_id", "item_id"], "left")
    units = F.coalesce(F.col("si"), F.lit(0))
    out = t.select("scope", "seller_id", "item_id", F.coalesce(F.col("title"), F.lit("")).alias("title"),
                   "visits", units.alias("units"), pct_or_zero(units, "visits").alias("units_per_visit_pct"),
                   F.col("rank").cast("bigint").alias("rank"))
    return seller_label(out, portfolio)


# ----------------------------------------------------------------------------- P38 / P39 campaigns
def campaign_seller_summary(campaigns: DataFrame, bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller rows, eligible, opted in, opted-in / eligible % (0 without eligible)."""
    per = campaigns.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("eligible"), F.lit(False))).alias("eligible"),
        F.count_if(F.coalesce(F.col("opt_in"), F.lit(False))).alias("opt_in"),
    )
    t = M.scoped(per, bridge)
    out = t.select("scope", "seller_id", "total", "eligible", "opt_in",
                   pct_or_zero("opt_in", "eligible").alias("optin_pct"))
    return seller_label(ranked(out, "eligible", bridge), portfolio)


def campaign_mart_order() -> list[Column]:
    """The campaign mart's sort (seller, newest day, opted in, type, item, ...)."""
    return [
        F.col("seller_id").asc(), F.col("day").desc(), F.col("opt_in").desc_nulls_last(),
        F.col("type").asc_nulls_first(), F.col("item_id").asc(), F.col("eligible").asc_nulls_first(),
        F.col("price_initial").asc_nulls_first(), F.col("price_final").asc_nulls_first(),
        F.col("status").asc_nulls_first(),
    ]


def campaign_item_table(campaigns: DataFrame, bridge: DataFrame, portfolio: DataFrame, k: int = 500) -> DataFrame:
    """The scope's top-k rows by 30-day gmv with type label and discount %
    ((1 - final / initial) * 100, NULL unless both prices are positive)."""
    t = top_per_scope(M.scoped(campaigns, bridge), [F.col("gmv_l30d").desc_nulls_last(), *campaign_mart_order()], k)
    ini, fin = F.col("price_initial"), F.col("price_final")
    disc = F.when((ini > 0) & fin.isNotNull() & (fin != 0),
                  (F.lit(1.0) - fin.cast("double") / ini.cast("double")) * 100.0)
    out = t.select(
        "scope", "seller_id", "type",
        F.coalesce(L.map_lookup("type", L.CAMPAIGN_TYPE_LABELS), F.col("type")).alias("type_label"),
        "item_id", "day", "eligible", "opt_in", "price_initial", "price_final",
        disc.alias("discount_pct"), "gmv_l30d", F.col("rank").cast("bigint").alias("rank"),
    )
    return seller_label(out, portfolio)


# ----------------------------------------------------------------------------- P40-P44 price
def price_kpi(price: DataFrame, bridge: DataFrame) -> DataFrame:
    """Σ comparison visits, Σ expensive visits, expensive % (0 without visits)."""
    per = price.groupBy("seller_id").agg(F.sum("visits_match").alias("vis"), F.sum("visits_exp3").alias("vis_exp"))
    s = M.scoped(per, bridge).groupBy("scope").agg(F.sum("vis").alias("visits"),
                                                   F.sum("vis_exp").alias("visits_exp"))
    s = M._zero_fill(s, bridge, ["visits", "visits_exp"])
    return s.select("scope", "visits", "visits_exp", pct_or_zero("visits_exp", "visits").alias("expensive_pct"))


def price_seller_table(price: DataFrame, bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller items, non-competitive items, visits, expensive visits, % and band.

    The band is of the percentage as shown, rounded to one decimal: 30.04 % is shown as 30.0 and is not above 30.
    """
    per = price.groupBy("seller_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("classification") == F.lit(L.NON_COMPETITIVE)).alias("non_competitive"),
        F.sum("visits_match").alias("visits"), F.sum("visits_exp3").alias("visits_exp"),
    )
    p = pct_or_zero("visits_exp", "visits")
    hi, mid = L.EXPENSIVE_BANDS
    t = M.scoped(per, bridge).select("scope", "seller_id", "items", "non_competitive", "visits", "visits_exp",
                                     p.alias("expensive_pct"))
    t = ranked(t, "visits_exp", bridge)
    shown = F.round("expensive_pct", 1)
    band = F.when(shown > hi, F.lit("high")).when(shown > mid, F.lit("medium"))
    return seller_label(t.withColumn("band", band.otherwise(F.lit("low"))), portfolio)


def price_item_table(price: DataFrame, bridge: DataFrame, portfolio: DataFrame, k: int = 200) -> DataFrame:
    """Non-competitive items of the scope, top-k by expensive exposure,
    with price gap % ((our / rival - 1) * 100, NULL if either is missing or 0)."""
    t = M.scoped(price.where(F.col("classification") == F.lit(L.NON_COMPETITIVE)), bridge)
    t = top_per_scope(t, [F.col("visits_exp3").desc_nulls_last(), *price_order()], k)
    ours, rival = F.col("our_price"), F.col("rival_price_min")
    gap = F.when((ours != 0) & (rival != 0), (ours.cast("double") / rival.cast("double") - 1.0) * 100.0)
    out = t.select("scope", "seller_id", "item_id", F.coalesce(F.col("title"), F.lit("")).alias("title"),
                   "our_price", "rival_price_min", gap.alias("gap_pct"), "rival_name", "visits_match",
                   "visits_exp3", "permalink", "rival_url", F.col("rank").cast("bigint").alias("rank"))
    return seller_label(out, portfolio)


def qualification_table(price: DataFrame, bridge: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Per seller the first qualification (not NULL, not empty) in mart order, with rank,
    label, benefit eligibility (C3 is not eligible; unknown codes are) and the
    seller's count of non-competitive items. Sellers without one are absent."""
    q = price.where(F.col("qualification") != "")
    w = Window.partitionBy("seller_id").orderBy(*price_order())
    first = q.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select("seller_id", "qualification")
    nc = price.groupBy("seller_id").agg(
        F.count_if(F.col("classification") == F.lit(L.NON_COMPETITIVE)).alias("non_competitive")
    )
    t = first.join(nc, "seller_id", "left")
    qual = F.col("qualification")
    t = t.select(
        "seller_id", "qualification",
        F.coalesce(L.map_lookup(qual, L.QUALIFICATION_RANK), F.lit(L.UNKNOWN_QUALIFICATION_RANK)).alias("qual_rank"),
        F.coalesce(L.map_lookup(qual, L.QUALIFICATION_LABELS), qual).alias("qual_label"),
        F.coalesce(L.map_lookup(qual, L.QUALIFICATION_ELIGIBLE), F.lit(True)).alias("benefit_eligible"),
        F.coalesce(F.col("non_competitive"), F.lit(0)).alias("non_competitive"),
    )
    return seller_label(M.scoped(t, bridge), portfolio)
