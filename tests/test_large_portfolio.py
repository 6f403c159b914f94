"""With a portfolio too large to broadcast, the portfolio filter moves after
aggregation (no raw-line shuffle by seller) and results stay identical."""

import pytest

import __spark_entry__ as entry
from sellerlens.plans.broadcast import MAX_ROWS_CONF
from tests.conftest import SF_SMALL
from tests.test_plans import formatted

NAMES = ["sales_monthly", "buybox_monthly", "top_items", "top_items_by_visits", "price_competitiveness",
         "campaign_items", "seller_sales_table", "ads_kpi"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())


@pytest.fixture()
def tiny_bound(spark):
    spark.conf.set(MAX_ROWS_CONF, "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset(MAX_ROWS_CONF)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_when_portfolio_is_not_broadcast(spark, name):
    q = entry.queries()[name]
    want = rows(q(spark, SF_SMALL))
    spark.conf.set(MAX_ROWS_CONF, "2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = q(spark, SF_SMALL)
        text = formatted(df)
        got = rows(df)
    finally:
        spark.conf.unset(MAX_ROWS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want
    assert "BroadcastHashJoin LeftSemi" not in text


def test_portfolio_join_follows_the_aggregate(spark, tiny_bound):
    text = formatted(entry.queries()["sales_monthly"](spark, SF_SMALL))
    tree = text.split("\n\n")[0]
    assert "LeftSemi" not in tree
    # the portfolio join is the top join; the seller aggregate sits below it
    top_join = tree.index("SortMergeJoin Inner")
    assert "HashAggregate" in tree[top_join:]
