"""The refresh writes the marts and reports that the standalone queries return, as one bundle."""

import datetime as dt
import json
import os
import tempfile
from collections import Counter
from types import SimpleNamespace

import pytest

import __spark_entry__ as entry
from sellerlens.plans import bundle as B
from sellerlens.plans.params import AS_OF, AUDIT_AS_OF, AUDIT_DAYS, CAMPAIGN_DAYS
from sellerlens.plans.registry import BUNDLE_MARTS, PERIODIC, REPORTS, Marts, period_of
from sellerlens.sources import store
from sellerlens.sources.bindings import BINDINGS, LogicalInputs
from sellerlens.sources.sinks import normalize
from sellerlens.sources.tables import load_tables
from tests.conftest import SF_SMALL

DAYS = {"audit_days": AUDIT_DAYS, "campaign_days": CAMPAIGN_DAYS}
STAMP = dt.datetime(2001, 7, 19, 8, 0)
# bundle mart -> query; the price and campaign marts are uncut in the bundle
QUERY_OF = {name: name for name in BUNDLE_MARTS.values()} | {
    "ads_daily": "ads_daily_mart", "ads_monthly": "ads_monthly_mart", "buybox_monthly": "buybox_monthly",
    "price_competitiveness": "price_competitiveness_all", "campaign_items": "campaign_items_all"}


def same(got, want) -> bool:
    columns = sorted(got.columns)
    rows = lambda df: Counter(repr([r[c] for c in columns]) for r in df.collect())
    return columns == sorted(want.columns) and rows(got) == rows(want)


@pytest.fixture(scope="module")
def inputs(spark):
    """Inputs that the caller has bound by hand, to frames of its own."""
    logical = LogicalInputs(load_tables(spark, SF_SMALL))
    return SimpleNamespace(**{name: getattr(logical, name) for name in BINDINGS})


@pytest.fixture(scope="module")
def out_dir(spark, inputs):
    out = os.path.join(tempfile.mkdtemp(prefix="sellerlens-bundle-"), "b")
    B.refresh(spark, inputs, out, AS_OF, AUDIT_AS_OF, refreshed_at=STAMP, **DAYS)
    return out


@pytest.mark.parametrize("mart", sorted(QUERY_OF))
def test_bundle_mart_equals_query(spark, out_dir, mart):
    got = spark.read.parquet(B.current_bundle(spark, out_dir)[mart])
    assert [r[0] for r in got.select("updated_at").distinct().collect()] in ([], ["19/07/2001 08:00"])
    assert same(got.drop("updated_at"), entry.queries()[QUERY_OF[mart]](spark, SF_SMALL))


def test_bundle_reports_equal_queries(spark, out_dir):
    paths = B.current_bundle(spark, out_dir)
    assert {f"report_{n}" for n in REPORTS} | set(QUERY_OF) | {"sellers"} == set(paths)
    m = Marts(LogicalInputs(load_tables(spark, SF_SMALL)))  # what the registered queries take
    for name, fn in REPORTS.items():
        got = spark.read.parquet(paths[f"report_{name}"]).drop("updated_at")
        assert same(got, normalize(fn(m))), name


def test_every_seller_with_offers_is_in_the_bundle(spark, out_dir, inputs):
    offers = inputs.campaign_optin.where("candidate_flag").select("seller_id").distinct()
    from sellerlens.functions.dates import since_window

    recent = inputs.campaign_optin.where("candidate_flag").where(since_window(AS_OF, CAMPAIGN_DAYS).predicate("day"))
    want = {r[0] for r in recent.select("seller_id").distinct().join(inputs.portfolio, "seller_id").select("seller_id").collect()}
    got = spark.read.parquet(B.current_bundle(spark, out_dir)["report_campaign_seller_summary"])
    assert {r[0] for r in got.select("seller_id").distinct().collect()} == want and offers.count() >= len(want) > 0


def test_json_values(spark, inputs, tmp_path):
    work = B.work_folder(spark)
    typed = B.write_typed_marts(inputs, work, AS_OF, AUDIT_AS_OF, **DAYS)
    paths = B.publish(spark, {n: typed[n] for n in ("sellers", "sales_monthly", "seller_reputation")}, str(tmp_path / "j"), fmt="json",
                      refreshed_at=STAMP)
    for name, df in (("sellers", inputs.portfolio), ("sales_monthly", typed["sales_monthly"]), ("seller_reputation", typed["seller_reputation"])):
        lines = [json.loads(r[0]) for r in spark.read.text(paths[name]).collect()]
        want = [{k: v for k, v in r.asDict().items() if v is not None} | {"updated_at": "19/07/2001 08:00"} for r in normalize(df).collect()]
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted(lines, key=key) == sorted(want, key=key) and lines


OTHER_DAY = dt.date(2000, 7, 19)


@pytest.fixture(scope="module")
def other_day(spark, inputs):
    """The typed marts and reports of a second as-of date."""
    work = B.work_folder(spark)
    typed = B.write_typed_marts(inputs, work, OTHER_DAY, AUDIT_AS_OF, **DAYS)
    return typed, B.build_reports(typed, OTHER_DAY)


def test_reports_follow_the_as_of_date(spark, inputs, other_day):
    _, reports = other_day
    m = Marts(inputs, as_of=OTHER_DAY)
    for name, df in reports.items():
        assert same(normalize(df), normalize(REPORTS[name](m))), name
    month = reports["sales_kpi_month"].where("scope = 'all'").first()
    assert month.gmv > 0


def test_any_report_in_any_mode(spark, inputs, other_day):
    typed, _ = other_day
    modes = ("day", "week", "year", "this_quarter")
    reports = B.build_reports(typed, OTHER_DAY, modes)
    assert {f"{base}_{mode}" for base in PERIODIC for mode in modes} <= set(reports)
    m = Marts(inputs, as_of=OTHER_DAY)
    for base in ("sales_kpi", "ads_seller_table", "conversion_series"):
        for mode in modes:
            assert same(normalize(reports[f"{base}_{mode}"]), normalize(PERIODIC[base](m, period_of(m, mode)))), (base, mode)


def test_reports_do_not_scan_facts(other_day):
    from tests.test_plans import formatted

    for name, df in other_day[1].items():
        text = formatted(df)
        for fact in ("lineitem.parquet", "orders.parquet", "events.parquet"):
            assert fact not in text, f"{name} scans {fact}"


def test_a_failed_write_leaves_the_old_bundle(spark, out_dir, inputs):
    from pyspark.sql import functions as F

    before = B.current_bundle(spark, out_dir)
    broken = {"sellers": inputs.portfolio, "broken": inputs.portfolio.select(F.raise_error(F.lit("stop")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="stop"):
        B.publish(spark, broken, out_dir, refreshed_at=STAMP + dt.timedelta(days=1))
    assert B.current_bundle(spark, out_dir) == before
    assert spark.read.parquet(before["sellers"]).count() == inputs.portfolio.count()


def test_a_new_bundle_replaces_the_old_at_once(spark, inputs, tmp_path):
    out = str(tmp_path / "b")
    for day in range(4):
        B.publish(spark, {"sellers": inputs.portfolio}, out, refreshed_at=STAMP + dt.timedelta(days=day))
    assert len(store.names(spark, f"{out}/versions")) == 2
    got = spark.read.parquet(B.current_bundle(spark, out)["sellers"])
    assert {r.updated_at for r in got.collect()} == {"22/07/2001 08:00"}


def test_failed_versions_do_not_count(spark, inputs, tmp_path):
    """Two good versions, two failed ones, one good: the last two good ones stay."""
    from pyspark.sql import functions as F

    out, good, bad = str(tmp_path / "b"), {"sellers": inputs.portfolio}, {"x": inputs.portfolio.select(F.raise_error(F.lit("stop")).cast("string").alias("x"))}
    kept = []
    for day, frames in enumerate((good, good, bad, bad, good)):
        try:
            kept.append(B.publish(spark, frames, out, refreshed_at=STAMP + dt.timedelta(days=day))["sellers"])
        except Exception as e:
            assert "stop" in str(e)
    assert [f"{out}/versions/{v}/sellers" for v in store.names(spark, f"{out}/versions")] == kept[-2:]
    assert all(spark.read.parquet(p).count() == inputs.portfolio.count() for p in kept[-2:])


def test_of_two_refreshes_at_once_one_wins(spark, inputs, tmp_path):
    out, frames = str(tmp_path / "b"), {"sellers": inputs.portfolio}
    B.publish(spark, frames, out, refreshed_at=STAMP)
    since = B.last_commit(spark, out)
    won = B.publish(spark, frames, out, refreshed_at=STAMP + dt.timedelta(days=2), since=since)
    with pytest.raises(B.Overtaken):
        B.publish(spark, frames, out, refreshed_at=STAMP + dt.timedelta(days=1), since=since)
    assert B.current_bundle(spark, out) == won and len(store.names(spark, f"{out}/versions")) == 2
    # a writer that is lost while it commits leaves a commit without a version: readers stay, and the next refresh goes on behind it
    assert store.create_text(spark, f"{out}/{B.COMMITS}/{B.last_commit(spark, out) + 1:08d}", "")
    assert B.current_bundle(spark, out) == won
    later = B.publish(spark, frames, out, refreshed_at=STAMP + dt.timedelta(days=3))
    assert B.current_bundle(spark, out) == later


def test_a_custom_period_of_the_caller(spark, inputs, other_day):
    typed, _ = other_day
    period = (dt.date(2000, 2, 10), dt.date(2000, 4, 2))
    reports = B.build_reports(typed, OTHER_DAY, [period])
    m = Marts(inputs, as_of=OTHER_DAY)
    for base in ("sales_kpi", "investment_seller_table", "visits_seller_table"):
        got = reports[f"{base}_2000-02-10_2000-04-02"]
        assert same(normalize(got), normalize(PERIODIC[base](m, m.period("custom", *period)))), base
        assert got.count()


def test_the_work_folder_is_deleted(spark, inputs, tmp_path, monkeypatch):
    work = str(tmp_path / "work")
    monkeypatch.setattr(B, "work_folder", lambda spark: work)
    B.refresh(spark, inputs, str(tmp_path / "b"), AS_OF, AUDIT_AS_OF, with_reports=False, **DAYS)
    assert not os.path.exists(work)
    monkeypatch.setattr(B, "publish", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        B.refresh(spark, inputs, str(tmp_path / "c"), AS_OF, AUDIT_AS_OF, with_reports=False, **DAYS)
    assert not os.path.exists(work)
