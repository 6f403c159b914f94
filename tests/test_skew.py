"""Hot keys: one seller holding over a third of all order lines.

The skewed input is derived from the given tables: every line of every third
order is reassigned to one seller. Per-task shuffle reads come from Spark's
event log. A plan that shuffled raw lines by seller would send all of the hot
seller's lines to one task; the marts aggregate map-side first (and cut top-k
per task), so no task reads more than a small fraction of them, whether the
portfolio is broadcast or applied after aggregation.
"""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import marts, price
from sellerlens.plans.broadcast import MAX_ROWS_CONF
from sellerlens.plans.params import AS_OF
from sellerlens.sources.bindings import LogicalInputs
from sellerlens.sources.tables import load_tables
from tests.conftest import SF_MID


def _make_hot(df, hot, key: str):
    return df.withColumn("seller_id", F.when(F.col(key) % 3 == 0, F.lit(hot)).otherwise(F.col("seller_id")))


@pytest.fixture(scope="module")
def skewed(spark):
    i = LogicalInputs(load_tables(spark, SF_MID))
    hot = i.portfolio.agg(F.min("seller_id")).first()[0]
    sales = _make_hot(i.sales, hot, "order_id")
    hot_lines = sales.where(F.col("seller_id") == hot).count()
    assert hot_lines * 3 > sales.count()
    return sales, i.portfolio, hot_lines, i.item_titles


@pytest.fixture(scope="module")
def skewed_inputs(spark):
    """visits and price observations with a hot seller (every row of every third item)."""
    i = LogicalInputs(load_tables(spark, SF_MID))
    hot = i.portfolio.agg(F.min("seller_id")).first()[0]
    out = {}
    for name, df in (("visits", i.visits), ("price_obs", i.price_obs)):
        df = _make_hot(df, hot, "item_id")
        rows = df.where(F.col("seller_id") == hot).count()
        assert rows * 3 > df.count()
        out[name] = (df, rows)
    return out, i.portfolio


def _log_paths(spark) -> list[str]:
    log_dir = spark.conf.get("spark.eventLog.dir").replace("file:", "")
    app = spark.sparkContext.applicationId
    # a single file, or (rolling logs, the default in Spark 4) a folder of event files
    paths = glob.glob(os.path.join(log_dir, app + "*")) or sorted(
        glob.glob(os.path.join(log_dir, f"eventlog_v2_{app}", "events_*")))
    assert paths, log_dir
    return paths


def log_position(spark) -> dict[str, int]:
    """How far the event log has come, to read on from there."""
    return {path: os.path.getsize(path) for path in _log_paths(spark)}


def events_since(spark, position: dict[str, int], word: str) -> list[dict]:
    """The events after `position` that mention `word`."""
    events = []
    for path in _log_paths(spark):
        with open(path, "rb") as fh:
            fh.seek(position.get(path, 0))
            events += [json.loads(line) for line in fh if word.encode() in line and line.endswith(b"\n")]
    return events


def _max_shuffle_records_per_task(spark, group: str, action) -> int:
    sc = spark.sparkContext
    before = log_position(spark)
    sc.setJobGroup(group, group)
    try:
        action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    st = sc.statusTracker()
    stages = {s for j in st.getJobIdsForGroup(group) for s in st.getJobInfo(j).stageIds}
    reads = [
        e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
        for e in events_since(spark, before, "SparkListenerTaskEnd")
        if e.get("Event") == "SparkListenerTaskEnd" and e.get("Stage ID") in stages
    ]
    assert reads, group
    return max(reads)


MARTS = {
    "sales_monthly": lambda s, p, t: marts.sales_monthly(s, AS_OF, p),
    "seller_day": lambda s, p, t: marts.seller_day(s, AS_OF, p),
    "buybox_monthly": lambda s, p, t: marts.buybox_monthly(s, AS_OF, p),
    "top_items": lambda s, p, t: marts.top_items(s, AS_OF, p, k=20, titles=t),
}


@pytest.mark.parametrize("large_portfolio", [False, True], ids=["broadcast", "after-aggregation"])
@pytest.mark.parametrize("name", sorted(MARTS))
def test_hot_seller_lines_never_reach_one_task(spark, skewed, name, large_portfolio):
    sales, portfolio, hot_lines, titles = skewed
    # 32 uncoalesced shuffle partitions: an even spread gives each task about 1/32 of a stage's
    # records, while a shuffle of raw lines by seller would give one task all `hot_lines`
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    if large_portfolio:
        settings.update({MAX_ROWS_CONF: "2", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = MARTS[name](sales, portfolio, titles)
        group = f"skew-{name}-{large_portfolio}"
        worst = _max_shuffle_records_per_task(
            spark, group, lambda: df.write.format("noop").mode("overwrite").save())
    finally:
        for k in settings:
            spark.conf.unset(k)
    # the hot seller alone has `hot_lines` raw lines; no task reads a quarter of that
    assert worst < hot_lines / 4, (name, worst, hot_lines)


def test_measurement_detects_a_raw_shuffle_by_seller(spark, skewed):
    """Control: repartitioning raw lines by seller does put the hot seller's lines in one task."""
    sales, _, hot_lines, _ = skewed
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = sales.select("seller_id", "gmv").repartition(32, "seller_id")
        worst = _max_shuffle_records_per_task(
            spark, "skew-control", lambda: df.write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert worst >= hot_lines


OTHER_MARTS = {
    "visits_monthly": ("visits", lambda d, p: marts.visits_monthly(d, AS_OF, p)),
    "top_items_by_visits": ("visits", lambda d, p: marts.top_items_by_visits(d, AS_OF, p, k=50)),
    "price_exposure": ("price_obs", lambda d, p: price.exposure(d, AS_OF, p)),
    "price_items_last_day": ("price_obs", lambda d, p: price.items_last_day(d, AS_OF, p)),
}


@pytest.mark.parametrize("large_portfolio", [False, True], ids=["broadcast", "after-aggregation"])
@pytest.mark.parametrize("name", sorted(OTHER_MARTS))
def test_hot_seller_rows_never_reach_one_task_in_other_marts(spark, skewed_inputs, name, large_portfolio):
    inputs, portfolio = skewed_inputs
    source, build = OTHER_MARTS[name]
    df_in, hot_rows = inputs[source]
    settings = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    if large_portfolio:
        settings.update({MAX_ROWS_CONF: "2", "spark.sql.autoBroadcastJoinThreshold": "-1"})
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = build(df_in, portfolio)
        worst = _max_shuffle_records_per_task(
            spark, f"skew-{name}-{large_portfolio}", lambda: df.write.format("noop").mode("overwrite").save())
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert worst < hot_rows / 4, (name, worst, hot_rows)
