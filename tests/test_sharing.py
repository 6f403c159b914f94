"""Reports are lazy, share a fact within their plan, and read only the days they need."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sellerlens.functions.calendar import needed_days, period_rows, resolve_period
from sellerlens.operators import marts
from sellerlens.operators import measures as M
from sellerlens.operators import reports as R
from sellerlens.operators.scopes import seller_scopes
from sellerlens.plans.broadcast import MAX_ROWS_CONF, forget_sizes
from sellerlens.plans.registry import REGISTRY, REPORTS, Marts, period_of
from sellerlens.plans.sharing import in_plan
from sellerlens.sources.bindings import LogicalInputs
from sellerlens.sources.sinks import normalize
from sellerlens.sources.tables import load_tables
from tests.conftest import SF_SMALL
from tests.test_plans import formatted, scans_of

D = dt.date


@pytest.fixture(scope="module")
def inputs(spark):
    return LogicalInputs(load_tables(spark, SF_SMALL))


def rows(df):
    columns = sorted(df.columns)
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


def test_uses_of_a_shared_table_run_it_once(spark, inputs):
    days = in_plan(marts.seller_day(inputs.sales, D(2001, 7, 19), None, measures=("gmv", "si")), ("seller_id",))
    per_month = days.groupBy(F.trunc("day", "month").alias("m"), "seller_id").agg(F.sum("gmv").alias("gmv"))
    newest = days.where(F.col("day") >= D(2001, 7, 1)).groupBy("seller_id").agg(F.sum("si").alias("si"))
    both = per_month.join(newest, "seller_id")
    scans = scans_of(spark, lambda: both.collect())
    assert scans == {"orders": 1, "lineitem": 1}, scans


@pytest.mark.parametrize("name", ["ads_kpi", "ads_seller_table", "scorecard", "catalog_table", "investment_seller_table_week",
                                  "seller_sales_table", "qualification_table"])
def test_shared_and_separate_facts_give_the_same_report(inputs, spark, name):
    assert rows(REGISTRY[name](spark, SF_SMALL)) == rows(normalize(REPORTS[name](Marts(inputs))))


@pytest.mark.parametrize("name", ["logistics_mix", "investment_seller_table_week", "ads_series", "visits_seller_table"])
def test_every_fact_is_read_once(spark, name):
    scans = scans_of(spark, lambda: REGISTRY[name](spark, SF_SMALL).collect())
    assert scans.get("orders", 0) <= 1 and scans["lineitem"] <= 2, scans  # ads and visits are lines too


def test_building_a_report_runs_no_job(spark):
    for name in ("ads_kpi", "price_kpi", "logistics_mix"):
        REGISTRY[name](spark, SF_SMALL)  # measures the portfolio once
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    for name in REPORTS:
        REGISTRY[name](spark, SF_SMALL)
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before


def test_a_week_reads_its_days_only(spark):
    text = formatted(REGISTRY["logistics_mix_week"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-01T00:00)" in text and "LessThan(o_orderdate,2001-07-15T00:00)" in text


def test_needed_days_are_disjoint_and_whole():
    month = needed_days(resolve_period(D(2001, 7, 19), "month"))
    assert month == ((D(2000, 7, 1), D(2000, 7, 31)), (D(2001, 6, 1), D(2001, 7, 31)))
    assert needed_days(resolve_period(D(2001, 7, 19), "week")) == ((D(2001, 6, 21), D(2001, 7, 18)),)


# ----------------------------------------------------------------------------- many as-of dates

@pytest.mark.parametrize("mode", ["day", "week", "month", "quarter", "year"])
def test_many_dates_in_one_plan_equal_one_at_a_time(spark, inputs, mode):
    dates = [D(2000, 12, 31), D(2001, 1, 1), D(2001, 3, 31), D(2001, 7, 14)]
    days = marts.seller_day(inputs.sales, max(dates), inputs.portfolio, measures=("gmv", "si"),
                            window=marts.DayWindow(D(1999, 1, 1), max(dates)))
    got = M.kpi_of_dates(days, ["gmv", "si"], dates, mode, seller_scopes(inputs.portfolio))
    for as_of in dates:
        m = Marts(inputs, as_of=as_of)
        want = M.kpi_delta(m.q01, m.q02, ["gmv", "si"], period_of(m, mode), m.bridge)
        assert rows(normalize(got.where(F.col("as_of") == as_of).drop("as_of"))) == rows(normalize(want)), (mode, as_of)


def test_ranges_end_before_their_date():
    assert period_rows([D(2001, 7, 1)], "month") == [
        (D(2001, 7, 1), "before", D(2001, 6, 1), D(2001, 6, 30)), (D(2001, 7, 1), "last_year", D(2000, 7, 1), D(2000, 7, 31))]


# ----------------------------------------------------------------------------- ranks

def test_ranks_of_a_large_portfolio_equal_one_window(spark):
    """Ranked in parts by the scope's percentiles, with many ties and nulls."""
    n = 3000
    sellers = spark.range(n).select(F.col("id").alias("seller_id"), F.lit("x").alias("name"), F.concat(F.lit("G"), F.col("id") % 3).alias("group_name"))
    bridge = seller_scopes(sellers)
    metric = F.when(F.col("seller_id") % 7 == 0, None).otherwise((F.col("seller_id") * 37) % 400).cast("decimal(18,2)")
    table = M.scoped(sellers.select("seller_id", metric.alias("gmv")), bridge)
    small = rows(R.ranked(table, "gmv", bridge))
    spark.conf.set(MAX_ROWS_CONF, "10")
    try:
        forget_sizes(spark)
        assert rows(R.ranked(table, "gmv", bridge)) == small
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
        forget_sizes(spark)
