"""Plan-shape assertions: pushdown, pruning, partial top-k, broadcasts, no slow paths."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.fixture(scope="module")
def queries():
    from sellerlens.plans.registry import REGISTRY

    return dict(REGISTRY)


def test_window_and_flag_pushed_to_orders_scan(spark, queries):
    text = formatted(queries["sales_monthly"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01T00:00)" in text
    assert "LessThan(o_orderdate,2001-07-19T00:00)" in text
    assert "Not(EqualTo(o_orderstatus,P))" in text
    # column pruning: the lineitem scan reads 4 of its 11 columns
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_extendedprice:double>" in text


@pytest.mark.parametrize("name", ["top_items", "top_items_by_visits", "visited_items_table", "campaign_item_table",
                                  "price_item_table", "qualification_item_table"])
def test_top_k_uses_partial_window_group_limit(spark, queries, name):
    text = formatted(queries[name](spark, SF_SMALL))
    assert text.count("WindowGroupLimit") >= 2, name


def test_portfolio_semi_join_is_broadcast(spark, queries):
    text = formatted(queries["sales_daily"](spark, SF_SMALL))
    assert "BroadcastHashJoin LeftSemi BuildRight" in text


def test_no_slow_paths_in_any_query(spark, queries):
    for name, q in queries.items():
        text = formatted(q(spark, SF_SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                    "FlatMapGroupsInPandas"):
            assert bad not in text, f"{name} uses {bad}"


def test_global_cut_is_take_ordered(spark, queries):
    text = formatted(queries["campaign_items"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in text


def test_size_check_runs_once_per_dimension_per_session(spark):
    from pyspark.sql import functions as F

    from sellerlens.plans.broadcast import MAX_BYTES_CONF, MAX_ROWS_CONF, forget_sizes, is_small
    from sellerlens.sources.tables import read_parquet

    path = f"{SF_SMALL}/supplier.parquet"

    def dim():
        return read_parquet(spark, path).select(F.col("s_suppkey").alias("seller_id"), F.lit("x").alias("tag"))

    st = spark.sparkContext.statusTracker()
    assert is_small(dim())
    before = set(st.getJobIdsForGroup(None))
    # a fresh read of the same dimension: answered from the session memo, no job
    assert is_small(dim())
    assert is_small(dim(), 5) is False  # 10 sellers at sf0.001: one capped count answers smaller bounds too
    assert set(st.getJobIdsForGroup(None)) == before
    # a refresh measures anew; and bytes count as well as rows
    forget_sizes(spark)
    assert is_small(dim()) and set(st.getJobIdsForGroup(None)) != before
    spark.conf.set(MAX_BYTES_CONF, "64")
    try:
        assert is_small(dim()) is False
    finally:
        spark.conf.unset(MAX_BYTES_CONF)
    # a different frame is counted on its own
    assert is_small(dim().where(F.col("seller_id") < 3), 5)
    # a lowered session bound is honoured
    spark.conf.set(MAX_ROWS_CONF, "3")
    try:
        assert is_small(dim()) is False
    finally:
        spark.conf.unset(MAX_ROWS_CONF)


def scans_of(spark, action) -> dict[str, int]:
    """File scans in the plans that ran during `action`, by table; a reused exchange runs no scan."""
    import json
    import re
    from collections import Counter

    from tests.test_skew import events_since, log_position

    before = log_position(spark)
    action()
    plans = {}
    for e in events_since(spark, before, "sparkPlanInfo"):
        plans[e["executionId"]] = e["sparkPlanInfo"]  # the last is the one that ran
    counts: Counter = Counter()

    def walk(node):
        if node["nodeName"].startswith("ReusedExchange"):
            return
        if node["nodeName"].startswith("Scan parquet"):
            counts.update(re.findall(r"/(\w+)\.parquet", json.dumps(node.get("metadata", {})) + node["simpleString"])[:1])
        for child in node["children"]:
            walk(child)

    for p in plans.values():
        walk(p)
    return dict(counts)


@pytest.mark.parametrize("name", ["growth_series", "seller_sales_table", "ads_kpi", "ads_ratios", "ads_seller_table",
                                  "scorecard", "catalog_table", "visit_kpi", "logistics_seller_table_week"])
def test_a_report_reads_the_orders_once(spark, queries, name):
    scans = scans_of(spark, lambda: queries[name](spark, SF_SMALL).collect())
    assert scans.get("orders") == 1, scans


@pytest.mark.parametrize("name", ["price_kpi", "price_seller_table", "price_item_table", "qualification_table"])
def test_a_report_reads_the_price_observations_once(spark, queries, name):
    scans = scans_of(spark, lambda: queries[name](spark, SF_SMALL).collect())
    assert scans.get("lineitem") == 1 and scans.get("part") == 1, scans


def test_titles_are_cut_to_the_ranked_items_before_any_shuffle(spark, queries):
    text = formatted(queries["top_items"](spark, SF_SMALL))
    tree = text.split("\n\n")[0]
    assert "BroadcastHashJoin LeftSemi BuildRight" in tree
