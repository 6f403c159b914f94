"""Properties over the real test tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from sellerlens.functions.calendar import resolve_period
from sellerlens.operators import marts, measures, reports
from sellerlens.operators.scopes import seller_scopes
from sellerlens.plans.params import AS_OF
from sellerlens.sources.bindings import LogicalInputs
from sellerlens.sources.tables import load_tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def inputs(spark):
    return LogicalInputs(load_tables(spark, SF_SMALL))


def test_logistic_classes_within_total(inputs):
    m = marts.logistics_monthly(inputs.sales, AS_OF, inputs.portfolio)
    assert m.where(F.col("gmv_ff") + F.col("gmv_xd") + F.col("gmv_ss") > F.col("gmv_total")).count() == 0
    assert m.where(F.col("si_ff") + F.col("si_xd") + F.col("si_ss") > F.col("si_total")).count() == 0


def test_buybox_orders_bounded(inputs):
    m = marts.buybox_monthly(inputs.sales, AS_OF, inputs.portfolio)
    assert m.where(F.col("orders_bb") > F.col("orders")).count() == 0
    assert m.where(F.col("gmv_bb") > F.col("gmv_total")).count() == 0


def test_month_rollup_equals_sum_of_days(inputs):
    s = inputs.sales
    daily = marts.sales_daily(s, AS_OF, days=400)  # a window covering whole months
    monthly = marts.sales_monthly(s, AS_OF)
    from_days = daily.where(F.col("day") >= "2001-01-01").groupBy(
        F.trunc("day", "month").alias("month"), "seller_id").agg(F.sum("gmv").alias("g"), F.sum("si").alias("u"))
    joined = monthly.where(F.col("month") >= "2001-01-01").join(from_days, ["month", "seller_id"], "full")
    assert joined.where((F.col("g") != F.col("gmv")) | (F.col("u") != F.col("si")) | F.col("g").isNull()
                        | F.col("gmv").isNull()).count() == 0


def test_scope_all_is_sum_of_sellers_and_shares_sum_to_100(inputs):
    q01 = marts.sales_monthly(inputs.sales, AS_OF, inputs.portfolio)
    q02 = marts.sales_daily(inputs.sales, AS_OF, inputs.portfolio)
    bridge = seller_scopes(inputs.portfolio)
    p = resolve_period(AS_OF, "quarter")
    t = reports.seller_sales_table(q01, q02, p, bridge, inputs.portfolio)
    tot = t.groupBy("scope").agg(F.sum("share_pct").alias("s"), F.sum("gmv").alias("g"))
    for r in tot.collect():
        assert r.s == pytest.approx(100.0) or r.g == 0
    kpi = {r.scope: r.gmv for r in measures.kpi_delta(q01, q02, ["gmv"], p, bridge).collect()}
    per_seller = sum(v for k, v in kpi.items() if k not in ("all",) and not k.startswith("G"))
    assert kpi["all"] == per_seller


def test_top_k_is_prefix_of_full_ranking(inputs):
    full = marts.top_items_by_visits(inputs.visits, AS_OF, k=10 ** 6)
    top = marts.top_items_by_visits(inputs.visits, AS_OF, k=3)
    assert top.join(full, ["seller_id", "item_id", "rank"], "left_anti").count() == 0
    assert top.count() == full.where("rank <= 3").count()
