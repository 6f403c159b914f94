"""Bindings of the logical inputs to the driver's test tables.

Each function maps physical TPC-H-style tables onto one logical table of
`schemas` with column expressions only (plus the lineitem-orders join for
order lines, and lineitem-part for price observations). The mappings are
fixed test fixtures, stated once here; the SQL oracle restates them in DuckDB.

All derived columns are plain Catalyst expressions, so predicates written by
the marts on logical columns (for example `closed_date >= d`) are unwrapped
by Catalyst into pushed parquet filters on the physical timestamp.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.labels import DEAL_PRE_AGREED, HOME_SITE, MATCH_TYPE
from sellerlens.sources.schemas import MONEY
from sellerlens.sources.tables import SourceTables

# ---------------------------------------------------------------------------
# Fixed values of the test-data bindings (FIXTURES.md), in natural order.
# ---------------------------------------------------------------------------
OTHER_SITE = "OTHER"
# order priority -> logistic type
PRIORITY_LOGISTIC = {
    "1-URGENT": "fulfillment",
    "2-HIGH": "cross_docking",
    "3-MEDIUM": "self_service",
    "4-NOT SPECIFIED": "other",
    "5-LOW": "drop_off",
}
DEAL_OTHER = "other"
# nation key % 7 -> reputation level (index 6 is NULL)
REPUTATION_LEVELS = ["red", "orange", "yellow", "green", "green_gold", "green_platinum", None]
# line number 1..7 -> campaign type
CAMPAIGN_TYPES = ["TIER_1", "TIER_3", "SMART", "CUSTOM", "PRENEGOTIATED", "LIGHTNING", "UNMAPPED"]
# k % 6 -> seller qualification (index 5 is NULL)
QUALIFICATIONS = ["C1", "C2", "C3", "C4", "RC", None]


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _lookup(key: Column, values: list, base: int = 0) -> Column:
    expr = None
    for i, v in enumerate(values):
        if v is None:
            continue
        cond = key == F.lit(i + base)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def _map_values(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr


def sales(t: SourceTables) -> DataFrame:
    """Order lines: lineitem joined to its order (every line has one)."""
    li = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    gmv = _money(F.col("l_extendedprice"))
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    prio = F.col("o_orderpriority")
    line = F.col("l_linenumber")
    ret = F.col("l_returnflag")
    open_line = F.col("l_linestatus") == F.lit("O")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("seller_id"),
        F.col("o_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.to_date("o_orderdate").alias("closed_date"),
        gmv.alias("gmv"),
        F.col("l_quantity").cast("bigint").alias("units"),
        (F.col("o_orderstatus") != F.lit("P")).alias("gmv_flag"),
        F.coalesce(_map_values(prio, PRIORITY_LOGISTIC), F.lit(None).cast("string")).alias("logistic_type"),
        F.when(ret == "A", F.lit(True)).when(ret == "R", F.lit(False)).alias("buybox_flag"),
        F.when(line == 1, F.lit(DEAL_PRE_AGREED)).when(line == 2, F.lit(DEAL_OTHER)).alias("deal_subtype"),
        F.when(open_line, gmv * disc).alias("deal_invest"),
        F.when(prio == "1-URGENT", gmv * tax).alias("dod_invest"),
        F.when(prio == "2-HIGH", gmv * tax).alias("lightning_invest"),
        F.when(line != 7, line.isin(1, 3)).alias("price_match_flag"),
        F.when(line != 7, line.isin(1, 4)).alias("smart_flag"),
        F.when(prio == "3-MEDIUM", gmv * tax).alias("auto_invest"),
        F.when(ret == "R", gmv * F.lit(Decimal("0.01"))).alias("coupon_amount"),
        F.when(ret == "R", open_line).alias("coupon_by_seller_flag"),
    )


def item_titles(t: SourceTables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_title"))


def _line_site() -> Column:
    return F.when(F.col("l_linenumber") == 7, F.lit(OTHER_SITE)).otherwise(F.lit(HOME_SITE))


def ads_daily(t: SourceTables) -> DataFrame:
    gmv = _money(F.col("l_extendedprice"))
    return t.lineitem.select(
        F.col("l_suppkey").alias("seller_id"),
        F.to_date("l_shipdate").alias("day"),
        _line_site().alias("site"),
        (gmv * F.col("l_discount").cast("decimal(4,2)")).alias("cost"),
        F.when(F.col("l_returnflag") == "A", gmv).otherwise(F.lit(Decimal("0.00")).cast(MONEY)).alias("attributed_gmv"),
        F.col("l_quantity").cast("bigint").alias("clicks"),
    )


def visits(t: SourceTables) -> DataFrame:
    qty = F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_partkey").alias("item_id"),
        F.to_date("l_shipdate").alias("day"),
        _line_site().alias("site"),
        (qty * 20).alias("pageviews"),
        F.when(F.col("l_returnflag") == "A", qty * 5).otherwise(F.lit(0).cast("bigint")).alias("pageviews_vip"),
        (qty * 20 - F.col("l_linenumber")).alias("visits"),
    )


def reputation(t: SourceTables) -> DataFrame:
    key = F.col("s_suppkey")

    def rate(mod: int) -> Column:
        return ((key % mod).cast("decimal(6,0)") / F.lit(1000)).cast("decimal(6,4)")

    return t.supplier.select(
        key.alias("seller_id"),
        F.lit(HOME_SITE).alias("site"),
        _lookup(F.col("s_nationkey") % 7, REPUTATION_LEVELS).alias("current_level"),
        _lookup((F.col("s_nationkey") + 1) % 7, REPUTATION_LEVELS).alias("real_level"),
        rate(50).alias("claims_rate"),
        rate(30).alias("delayed_rate"),
        rate(10).alias("cancel_rate"),
        (key * 10).cast("double").alias("tx_3m"),
    )


def price_obs(t: SourceTables) -> DataFrame:
    li = t.lineitem.select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate",
    )
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    line = F.col("l_linenumber")
    rival = (_money(F.col("p_retailprice")) * F.col("l_quantity").cast("decimal(9,0)")).cast(MONEY)
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("seller_id"),
        (F.col("l_partkey") % 100).alias("item_id"),
        F.concat(F.lit("C"), (F.col("l_partkey") % 20).cast("string")).alias("catalog_id"),
        F.to_date("l_shipdate").alias("day"),
        F.lit(HOME_SITE).alias("site"),
        F.when(line == 7, F.lit("OTHER")).otherwise(F.lit(MATCH_TYPE)).alias("type"),
        F.when(line == 6, F.lit("true")).otherwise(F.lit("false")).alias("bulky"),
        _money(F.col("l_extendedprice")).alias("our_price"),
        F.when(line != 5, rival).alias("rival_price"),
        F.col("l_quantity").cast(MONEY).alias("visits_match"),
        F.col("p_brand").alias("rival_name"),
        F.concat(F.lit("http://rival/"), F.col("l_partkey").cast("string")).alias("rival_url"),
        F.concat(F.lit("http://item/"), F.col("l_partkey").cast("string")).alias("permalink"),
        F.col("p_name").alias("title"),
    )


def price_audit(t: SourceTables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    value = _money(F.col("value"))
    return t.events.select(
        F.col("ts").alias("arrival_ts"),
        F.col("event_id"),
        F.struct(
            (F.col("user_id") % 100).alias("seller_id"),
            F.concat(F.lit(HOME_SITE), k.cast("string")).alias("item_id"),
            (value * 100).cast(MONEY).alias("item_price"),
            F.when(F.col("event_type") != "error", (value * 97).cast(MONEY)).alias("target_price"),
            F.col("event_type").alias("rival_name"),
            F.lit(None).cast("string").alias("rival_url"),
            F.lit(None).cast("string").alias("permalink"),
            (F.col("event_type") == "purchase").alias("is_offender"),
            _lookup(k % 6, QUALIFICATIONS).alias("qualification"),
        ).alias("value"),
    )


def campaign_optin(t: SourceTables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_linenumber").alias("promotion_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_suppkey").alias("seller_id"),
        _lookup(F.col("l_linenumber"), CAMPAIGN_TYPES, base=1).alias("type"),
        F.to_date("l_shipdate").alias("day"),
        F.lit(HOME_SITE).alias("site"),
        (F.col("l_returnflag") != "N").alias("candidate_flag"),
        (F.col("l_linestatus") == "O").alias("offer_flag"),
        _money(F.col("l_extendedprice")).alias("gmv_l30d"),
    )


def campaign_eligible(t: SourceTables) -> DataFrame:
    first = _money(F.col("p_retailprice"))
    tag = F.round(first * (F.lit(100) - F.col("p_size")).cast("decimal(3,0)") * F.lit(Decimal("0.01")), 2)
    return t.part.select(
        (F.col("p_size") % 7 + 1).alias("campaign_id"),
        F.col("p_partkey").alias("item_id"),
        first.alias("first_price"),
        tag.cast(MONEY).alias("tag_price"),
        F.col("p_type").alias("status"),
    )


def portfolio(t: SourceTables) -> DataFrame:
    """Every supplier is a portfolio seller; groups by key modulo 5."""
    return t.supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("G"), (F.col("s_suppkey") % 5).cast("string")).alias("group_name"),
    )


BINDINGS = {
    "sales": sales, "item_titles": item_titles, "ads_daily": ads_daily, "visits": visits,
    "reputation": reputation, "price_obs": price_obs, "price_audit": price_audit,
    "campaign_optin": campaign_optin, "campaign_eligible": campaign_eligible, "portfolio": portfolio,
}


class LogicalInputs:
    """Logical tables over one set of source tables (lazy, built per access)."""

    def __init__(self, tables: SourceTables):
        self.tables = tables
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in BINDINGS:
            if name not in self._frames:
                self._frames[name] = BINDINGS[name](self.tables)
            return self._frames[name]
        raise AttributeError(name)
