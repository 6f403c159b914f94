"""Daily refresh: all marts and reports of one as-of date, published as one bundle.

The caller passes its logical inputs (any object with the frames of `LogicalInputs`
as attributes), the as-of date and the report modes; nothing here knows the
test bindings.

The expensive part - order lines restricted to the two-year window,
countable lines and the portfolio - runs once and is written to the shared
checkpoint folder (`spark.checkpoint.dir`). From that slice:

  * `seller_day` (every additive sales measure per day and seller, exact) is
    computed in one pass and written next to it; the six additive sales marts
    (Q01-Q03, Q05, Q06, Q08) roll up from it, so they read a per-seller-day
    table instead of the lines;
  * the two non-additive marts read the slice: distinct orders (Q09) and the
    item ranking (Q10, whose 3-month window skips row groups by day);
  * in the same first phase, `ads_day`, `visits_day` (per day and seller) and
    `price_days` (observations per item and day) are written from one read of
    their sources; Q04, Q07, Q12, Q13 and Q15 roll up from them.

Writing tables (rather than caching) cuts the lineage, so a lost executor
re-reads a written table instead of recomputing the join. The tables of a
refresh live in one work folder, which is deleted when the bundle is out.

A bundle is a folder of versions and a folder of numbered commits, small files that name a version each. A
version is written whole, then the commit behind the last one is created, which the store refuses if there is one:
readers see the old bundle or the new one, with one refresh stamp. No rename is needed, so object stores serve as well. Of two refreshes that began
at the same commit one wins, and the other fails like any refresh that fails: its version is deleted and the bundle stays as it was.

The 90-day and 3-month windows lie inside the two-year window (which starts
on January 1st of the previous year), so one slice serves every sales mart.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.functions.dates import two_year_window
from sellerlens.operators import marts, price
from sellerlens.operators.scopes import in_portfolio, split_portfolio
from sellerlens.plans.broadcast import forget_sizes
from sellerlens.session import checkpoint_dir
from sellerlens.sources import store
from sellerlens.sources.sinks import normalize, with_refresh_stamp

SALES_SLICE_COLUMNS = (
    "seller_id", "order_id", "item_id", "closed_date", "gmv", "units", "gmv_flag", "logistic_type",
    "buybox_flag", "deal_subtype", "deal_invest", "dod_invest", "lightning_invest", "price_match_flag",
    "smart_flag", "auto_invest", "coupon_amount", "coupon_by_seller_flag",
)
COMMITS, VERSIONS = "_commits", "versions"


class Overtaken(RuntimeError):
    """Another refresh was published since this one began."""


def work_folder(spark: SparkSession) -> str:
    """A new folder for the tables of one refresh, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/refresh-{uuid.uuid4().hex}"


def _slice_rows(sales: DataFrame, as_of: dt.date, portfolio: DataFrame | None) -> DataFrame:
    """Countable, in-window order lines, sorted by day within each task (no shuffle), so that parquet
    row-group statistics on closed_date let the 3-month item ranking (Q10) skip most of the slice."""
    df = in_portfolio(sales.where(F.col("gmv_flag") & two_year_window(as_of).predicate("closed_date")), portfolio)
    return df.select(*SALES_SLICE_COLUMNS).sortWithinPartitions("closed_date", "seller_id")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_all(write, items: dict, parallel_jobs: int) -> dict:
    """Apply `write` to every (name, frame); independent Spark jobs are submitted from a
    few driver threads, so small marts run beside large ones instead of after them."""
    if parallel_jobs <= 1:
        return {name: write(name, df) for name, df in items.items()}
    with ThreadPoolExecutor(max_workers=parallel_jobs) as pool:
        futures = {name: pool.submit(write, name, df) for name, df in items.items()}
        return {name: f.result() for name, f in futures.items()}


def build_marts(inputs, work: str, as_of: dt.date, audit_as_of: dt.datetime,
                audit_days: int = 3, campaign_days: int = 2, parallel_jobs: int = 4) -> dict[str, DataFrame]:
    """The bundle's marts as lazy frames (the slice and the day tables are written under `work`)."""
    pf = inputs.portfolio
    forget_sizes(pf)
    early, late = split_portfolio(pf)
    first = _write_all(lambda name, df: _written(df, f"{work}/{name}"), {
        "sales-slice": _slice_rows(inputs.sales, as_of, early),
        "ads-day": marts.ads_day(inputs.ads_daily, as_of, pf),
        "visits-day": marts.visits_day(inputs.visits, as_of, pf),
        "price-days": price.price_days(inputs.price_obs, as_of),
    }, parallel_jobs)
    sales = first["sales-slice"]
    days = _written(marts.seller_day(sales, as_of, late), f"{work}/seller-day")
    return {
        **marts.sales_marts_from_days(days, as_of),
        **marts.ads_marts_from_days(first["ads-day"], as_of),
        **marts.visits_marts_from_days(first["visits-day"], as_of),
        "buybox_monthly": marts.buybox_monthly(sales, as_of, late),
        "top_items": marts.top_items(sales, as_of, late, k=20, titles=inputs.item_titles),
        "seller_reputation": marts.seller_reputation(inputs.reputation, pf),
        "top_items_by_visits": marts.top_items_by_visits(inputs.visits, as_of, pf, k=50),
        "price_competitiveness": price.price_competitiveness(
            inputs.price_obs, inputs.price_audit, as_of, audit_as_of, pf, audit_days=audit_days,
            days_table=first["price-days"]),
        "campaign_items": marts.campaign_items(inputs.campaign_optin, inputs.campaign_eligible, as_of, pf,
                                               days=campaign_days),
        "sellers": pf,
    }


def write_typed_marts(inputs, work: str, as_of: dt.date, audit_as_of: dt.datetime,
                      parallel_jobs: int = 4, **kw) -> dict[str, DataFrame]:
    """Write every mart with its exact types (decimals, dates) under `work` and return the
    written tables: the input of the published bundle and of the reports."""
    built = build_marts(inputs, work, as_of, audit_as_of, parallel_jobs=parallel_jobs, **kw)
    return _write_all(lambda name, df: _written(df, f"{work}/marts/{name}"), built, parallel_jobs)


class _Portfolio:
    """The only input that reports take besides the written marts."""

    def __init__(self, portfolio: DataFrame):
        self.portfolio = portfolio


#: A period mode or quick range by name, or the first and last day of a period of the caller.
Mode = str | tuple[dt.date, dt.date]


def build_reports(typed: dict[str, DataFrame], as_of: dt.date, modes: Iterable[Mode] | None = None) -> dict[str, DataFrame]:
    """The post-mart reports (P01-P45) over the typed marts of one refresh, for its own as-of date.

    By default every registered combination of report and period; with `modes`
    (day, week, month, quarter, year, a quick range, or a custom period as its first and last day) every periodic report in
    each of them, named <report>_<mode> or <report>_<first>_<last>, and the reports without a period.
    They read only the written marts and the portfolio, never the facts, so
    their cost does not grow with the fact tables.
    """
    from sellerlens.plans.registry import BUNDLE_MARTS, PERIODIC, PLAIN, REPORTS, Marts, period_of

    m = Marts(_Portfolio(typed["sellers"]), {q: typed[name] for q, name in BUNDLE_MARTS.items()}, as_of=as_of)
    if modes is None:
        return {name: fn(m) for name, fn in REPORTS.items()}
    out = {name: fn(m) for name, fn in PLAIN.items()}
    for mode in modes:
        label = mode if isinstance(mode, str) else "_".join(d.isoformat() for d in mode)
        out |= {f"{base}_{label}": fn(m, period_of(m, mode)) for base, fn in PERIODIC.items()}
    return out


def commits(spark: SparkSession, out_dir: str) -> list[tuple[int, str]]:
    """(number, version) of the published versions, in order; a commit without a name is one whose writer was lost, and counts for its number alone."""
    return [(int(n), store.read_text(spark, f"{out_dir}/{COMMITS}/{n}")) for n in store.names(spark, f"{out_dir}/{COMMITS}") if n.isdigit()]


def last_commit(spark: SparkSession, out_dir: str) -> int:
    return max((int(n) for n in store.names(spark, f"{out_dir}/{COMMITS}") if n.isdigit()), default=0)


def publish(spark: SparkSession, frames: dict[str, DataFrame], out_dir: str, fmt: str = "parquet",
            refreshed_at: dt.datetime | None = None, parallel_jobs: int = 4, keep: int = 2, since: int | None = None) -> dict[str, str]:
    """Write frames as a new version of the bundle in out_dir and make it the current one.

    Each frame goes to <version>/<name> at the output edge (S03 types, refresh stamp; `fmt` json for S05).
    `since` is the last commit that the refresh knows of (by default the last one now): a later one overtakes it.
    The newest `keep` published versions stay, so readers of the one before are not cut off; older ones, and what
    lost refreshes have left before them, are deleted.
    """
    since = last_commit(spark, out_dir) if since is None else since
    refreshed_at = refreshed_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    version = f"{refreshed_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    folder = f"{out_dir}/{VERSIONS}/{version}"

    def write(name: str, df: DataFrame) -> str:
        with_refresh_stamp(normalize(df), refreshed_at).write.format(fmt).save(f"{folder}/{name}")
        return f"{folder}/{name}"

    try:
        paths = _write_all(write, frames, parallel_jobs)
        if not store.create_text(spark, f"{out_dir}/{COMMITS}/{since + 1:08d}", version):
            raise Overtaken(f"{out_dir} was published by another refresh since commit {since}")
    except BaseException:
        store.delete(spark, folder)
        raise
    stay = [v for _, v in commits(spark, out_dir) if v][-keep:]
    for old in store.names(spark, f"{out_dir}/{VERSIONS}"):
        if old not in stay and old < stay[0]:
            store.delete(spark, f"{out_dir}/{VERSIONS}/{old}")
    return paths


def current_bundle(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """name -> path of the frames of the current bundle."""
    version = [v for _, v in commits(spark, out_dir) if v][-1]
    folder = f"{out_dir}/{VERSIONS}/{version}"
    return {name: f"{folder}/{name}" for name in store.names(spark, folder)}


def refresh(spark: SparkSession, inputs, out_dir: str, as_of: dt.date, audit_as_of: dt.datetime, fmt: str = "parquet",
            refreshed_at: dt.datetime | None = None, modes: Iterable[Mode] | None = None, with_reports: bool = True,
            **kw) -> dict[str, str]:
    """One daily refresh: the marts and, in the same bundle, all reports of `as_of`; name -> path."""
    work, since = work_folder(spark), last_commit(spark, out_dir)
    try:
        typed = write_typed_marts(inputs, work, as_of, audit_as_of, **kw)
        reports = {f"report_{name}": df for name, df in build_reports(typed, as_of, modes).items()} if with_reports else {}
        return publish(spark, typed | reports, out_dir, fmt, refreshed_at, since=since)
    finally:
        store.delete(spark, work)
