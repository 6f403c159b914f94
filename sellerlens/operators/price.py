"""Q15: price competitiveness per item, in five separately usable stages.

  a last_day        newest observation day of the last 15 (all sellers)  -> 1 row
  b exposure        comparison visits per (seller, catalog product), with
                    those where our price exceeds 1.03 x the rival's     -> agg
  c items_last_day  cheapest rival per (seller, catalog, item) that day  -> top-1
  d audit_latest    newest audit record per (item, seller)              -> top-1
  e assemble        b join c on (seller, catalog); left join d; classify; sort; cut

Stages a to c are sums and minima of the same observations, so `price_days`
reduces them once to one row per (seller, catalog, item, day): the exposure sums
and the cheapest rival as a `min` of one struct, all combined map-side. Stages a
to c then roll up from that table (`*_of_days`), which a caller writes once when it
needs more than one of them. The one-row last day is broadcast (its size is 1
by construction); "newest per key" in d is `row_number() = 1`, planned with a
partial WindowGroupLimit. Ties are broken by every remaining column so results
are deterministic.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions.dates import since_window
from sellerlens.functions.labels import COMPETITIVE, HOME_SITE, MATCH_TYPE, NON_COMPETITIVE, PRICE_TOLERANCE
from sellerlens.operators.scopes import in_portfolio, keep_portfolio_sellers, split_portfolio
from sellerlens.sources.schemas import require


def _expensive(ours: Column, rival: Column) -> Column:
    return (ours > 0) & (rival > 0) & (ours > F.lit(Decimal(PRICE_TOLERANCE)) * rival)


def _observations(obs: DataFrame, as_of: dt.date, days: int, site: str, match_type: str) -> DataFrame:
    require(obs, ["seller_id", "item_id", "catalog_id", "day", "site", "type", "bulky", "our_price",
                  "rival_price", "visits_match"], "price_obs")
    return obs.where(
        (F.col("type") == F.lit(match_type)) & (F.col("site") == F.lit(site))
        & (F.col("bulky") == F.lit("false")) & since_window(as_of, days).predicate("day")
    )


ITEM_COLUMNS = ("our_price", "rival_price", "rival_name", "rival_url", "permalink", "title")
#: Order of "cheapest": a missing rival price first, then every other column (a struct compares field by field, nulls first).
_CHEAPEST = ("rival_price", *(c for c in ITEM_COLUMNS if c != "rival_price"), "visits_match")


def price_days(obs: DataFrame, as_of: dt.date, days: int = 15, site: str = HOME_SITE,
               match_type: str = MATCH_TYPE) -> DataFrame:
    """The observations of the window, one row per (seller, catalog, item, day), of every seller.

    _vm and _ve are the visits and those at an expensive price; _cheapest is the cheapest rival's row.
    """
    expensive = F.when(_expensive(F.col("our_price"), F.col("rival_price")), F.col("visits_match")).otherwise(F.lit(0))
    return _observations(obs, as_of, days, site, match_type).groupBy("seller_id", "catalog_id", "item_id", "day").agg(
        F.sum("visits_match").alias("_vm"), F.sum(expensive).alias("_ve"), F.min(F.struct(*_CHEAPEST)).alias("_cheapest"))


def _portfolio_rows(agg: DataFrame, portfolio: DataFrame | None) -> DataFrame:
    early, late = split_portfolio(portfolio)
    return keep_portfolio_sellers(in_portfolio(agg, early), late)


def last_day_of_days(days_table: DataFrame) -> DataFrame:
    return days_table.agg(F.max("day").alias("max_day"))


def exposure_of_days(days_table: DataFrame, portfolio: DataFrame | None = None) -> DataFrame:
    agg = days_table.groupBy("seller_id", "catalog_id").agg(F.sum("_vm").alias("_vm"), F.sum("_ve").alias("_ve"))
    return _portfolio_rows(agg.where(F.col("_vm") > 0), portfolio).select(
        "seller_id", "catalog_id", F.round("_vm", 2).alias("visits_match"), F.round("_ve", 2).alias("visits_exp3"))


def items_last_day_of_days(days_table: DataFrame, portfolio: DataFrame | None = None) -> DataFrame:
    newest = days_table.join(F.broadcast(last_day_of_days(days_table)), F.col("day") == F.col("max_day"))
    return _portfolio_rows(newest, portfolio).select(
        "seller_id", "catalog_id", "item_id", *[F.col(f"_cheapest.{c}").alias(c) for c in ITEM_COLUMNS])


def last_day(obs: DataFrame, as_of: dt.date, days: int = 15, site: str = HOME_SITE,
             match_type: str = MATCH_TYPE) -> DataFrame:
    """One row (max_day) over every seller's recent observations."""
    return _observations(obs, as_of, days, site, match_type).agg(F.max("day").alias("max_day"))


def exposure(obs: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, days: int = 15,
             site: str = HOME_SITE, match_type: str = MATCH_TYPE) -> DataFrame:
    """(seller_id, catalog_id, visits_match, visits_exp3), positive exposure only."""
    return exposure_of_days(price_days(obs, as_of, days, site, match_type), portfolio)


def items_last_day(obs: DataFrame, as_of: dt.date, portfolio: DataFrame | None = None, days: int = 15,
                   site: str = HOME_SITE, match_type: str = MATCH_TYPE) -> DataFrame:
    """Per (seller, catalog, item) on the last day, the cheapest rival row.

    A missing (NULL) rival price comes first.
    """
    return items_last_day_of_days(price_days(obs, as_of, days, site, match_type), portfolio)


def audit_latest(audit: DataFrame, audit_as_of: dt.datetime | dt.date, portfolio: DataFrame | None = None,
                 days: int = 3) -> DataFrame:
    """Q15d: newest audit record per (item, seller) since audit_as_of's date - days.

    The window compares the raw arrival timestamp with midnight of the start
    day (equivalent to DATE(ts) >= start, and pushable). Newest = latest
    arrival, then highest event id.
    """
    require(audit, ["arrival_ts", "value"], "price_audit")
    as_of_day = audit_as_of.date() if isinstance(audit_as_of, dt.datetime) else audit_as_of
    start = dt.datetime.combine(as_of_day - dt.timedelta(days=days), dt.time())
    since = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")  # zone-independent literal
    flat = audit.where(F.col("arrival_ts") >= since).select(
        "arrival_ts", "event_id",
        F.col("value.seller_id").alias("seller_id"), F.col("value.item_id").alias("audit_item_id"),
        F.col("value.item_price").alias("a_our_price"), F.col("value.target_price").alias("a_target_price"),
        F.col("value.rival_name").alias("a_rival_name"), F.col("value.rival_url").alias("a_rival_url"),
        F.col("value.permalink").alias("a_permalink"), F.col("value.is_offender").alias("is_offender"),
        F.col("value.qualification").alias("qualification"),
    )
    early, late = split_portfolio(portfolio)
    flat = in_portfolio(flat, early)
    w = Window.partitionBy("audit_item_id", "seller_id").orderBy(
        F.col("arrival_ts").desc(), F.col("event_id").desc()
    )
    newest = flat.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return keep_portfolio_sellers(newest, late)


def price_competitiveness(obs: DataFrame, audit: DataFrame, as_of: dt.date, audit_as_of: dt.datetime | dt.date,
                          portfolio: DataFrame | None = None, days: int = 15, audit_days: int = 3,
                          site: str = HOME_SITE, match_type: str = MATCH_TYPE,
                          limit: int | None = None, days_table: DataFrame | None = None) -> DataFrame:
    """Q15e: assemble and classify.

    All rows by default; `limit` cuts them in the reference's order (seller id as text,
    expensive exposure descending), which keeps the first sellers only, so reports
    never use it. `days_table` is a written `price_days` result, so that the
    observations are read once.
    """
    base = price_days(obs, as_of, days, site, match_type) if days_table is None else days_table
    b = exposure_of_days(base, portfolio)
    i = items_last_day_of_days(base, portfolio)
    a = audit_latest(audit, audit_as_of, portfolio, audit_days)
    bi = b.join(i, ["seller_id", "catalog_id"])
    bi = bi.withColumn("audit_item_id", F.concat(F.lit(site), F.col("item_id").cast("string")))
    full = bi.join(a, ["audit_item_id", "seller_id"], "left")
    ours = F.coalesce(F.col("a_our_price"), F.col("our_price"))
    rival = F.coalesce(F.col("a_target_price"), F.col("rival_price"))
    out = full.select(
        "seller_id", "item_id", "visits_match", "visits_exp3",
        ours.alias("our_price"),
        rival.alias("rival_price_min"),
        F.coalesce(F.col("a_rival_name"), F.col("rival_name")).alias("rival_name"),
        F.coalesce(F.col("a_rival_url"), F.col("rival_url")).alias("rival_url"),
        F.coalesce(F.col("a_permalink"), F.col("permalink")).alias("permalink"),
        "title", "qualification",
        F.when(_expensive(ours, rival), F.lit(NON_COMPETITIVE)).otherwise(F.lit(COMPETITIVE)).alias("classification"),
    )
    if limit is None:
        return out
    return out.orderBy(*price_order()).limit(limit)


def price_order() -> list[Column]:
    """(seller id as text asc, visits_exp3 desc) completed to a total order."""
    return [
        F.col("seller_id").cast("string").asc(), F.col("visits_exp3").desc_nulls_last(), F.col("item_id").asc(),
        F.col("visits_match").asc_nulls_first(), F.col("our_price").asc_nulls_first(),
        F.col("rival_price_min").asc_nulls_first(), F.col("rival_name").asc_nulls_first(),
        F.col("rival_url").asc_nulls_first(), F.col("permalink").asc_nulls_first(),
        F.col("title").asc_nulls_first(), F.col("qualification").asc_nulls_first(),
    ]
