"""Declared schemas of the logical inputs.

The marts read these logical tables, never physical column names, so a
deployment binds its own warehouse tables to them (see `bindings`) and the
operators stay unchanged. `require` validates column presence on entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(6, 4)


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SALES = _s(
    ("seller_id", T.LongType()), ("order_id", T.LongType()), ("item_id", T.LongType()),
    ("item_title", T.StringType()), ("closed_date", T.DateType()), ("gmv", MONEY),
    ("units", T.LongType()), ("gmv_flag", T.BooleanType()), ("logistic_type", T.StringType()),
    ("buybox_flag", T.BooleanType()), ("deal_subtype", T.StringType()),
    ("deal_invest", T.DecimalType(23, 4)), ("dod_invest", T.DecimalType(23, 4)),
    ("lightning_invest", T.DecimalType(23, 4)), ("price_match_flag", T.BooleanType()),
    ("smart_flag", T.BooleanType()), ("auto_invest", T.DecimalType(23, 4)),
    ("coupon_amount", T.DecimalType(21, 4)), ("coupon_by_seller_flag", T.BooleanType()),
)

ADS_DAILY = _s(
    ("seller_id", T.LongType()), ("day", T.DateType()), ("site", T.StringType()),
    ("cost", T.DecimalType(23, 4)), ("attributed_gmv", MONEY), ("clicks", T.LongType()),
)

VISITS = _s(
    ("seller_id", T.LongType()), ("item_id", T.LongType()), ("day", T.DateType()),
    ("site", T.StringType()), ("pageviews", T.LongType()), ("pageviews_vip", T.LongType()),
    ("visits", T.LongType()),
)

REPUTATION = _s(
    ("seller_id", T.LongType()), ("site", T.StringType()), ("current_level", T.StringType()),
    ("real_level", T.StringType()), ("claims_rate", RATE), ("delayed_rate", RATE),
    ("cancel_rate", RATE), ("tx_3m", T.DoubleType()),
)

PRICE_OBS = _s(
    ("seller_id", T.LongType()), ("item_id", T.LongType()), ("catalog_id", T.StringType()),
    ("day", T.DateType()), ("site", T.StringType()), ("type", T.StringType()),
    ("bulky", T.StringType()), ("our_price", MONEY), ("rival_price", MONEY),
    ("visits_match", MONEY), ("rival_name", T.StringType()), ("rival_url", T.StringType()),
    ("permalink", T.StringType()), ("title", T.StringType()),
)

AUDIT_VALUE = _s(
    ("seller_id", T.LongType()), ("item_id", T.StringType()), ("item_price", MONEY),
    ("target_price", MONEY), ("rival_name", T.StringType()), ("rival_url", T.StringType()),
    ("permalink", T.StringType()), ("is_offender", T.BooleanType()),
    ("qualification", T.StringType()),
)

PRICE_AUDIT = _s(("arrival_ts", T.TimestampNTZType()), ("event_id", T.LongType()), ("value", AUDIT_VALUE))

CAMPAIGN_OPTIN = _s(
    ("promotion_id", T.IntegerType()), ("item_id", T.LongType()), ("seller_id", T.LongType()),
    ("type", T.StringType()), ("day", T.DateType()), ("site", T.StringType()),
    ("candidate_flag", T.BooleanType()), ("offer_flag", T.BooleanType()), ("gmv_l30d", MONEY),
)

CAMPAIGN_ELIGIBLE = _s(
    ("campaign_id", T.IntegerType()), ("item_id", T.LongType()), ("first_price", MONEY),
    ("tag_price", MONEY), ("status", T.StringType()),
)

PORTFOLIO = _s(("seller_id", T.LongType()), ("name", T.StringType()), ("group_name", T.StringType()))

ITEM_TITLES = _s(("item_id", T.LongType()), ("item_title", T.StringType()))

LOGICAL = {
    "sales": SALES, "ads_daily": ADS_DAILY, "visits": VISITS, "reputation": REPUTATION,
    "price_obs": PRICE_OBS, "price_audit": PRICE_AUDIT, "campaign_optin": CAMPAIGN_OPTIN,
    "campaign_eligible": CAMPAIGN_ELIGIBLE, "portfolio": PORTFOLIO, "item_titles": ITEM_TITLES,
}


def require(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "input") -> DataFrame:
    """Fail fast (at plan time, no job) when an operator's input lacks columns."""
    missing = [c for c in columns if c.split(".")[0] not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {df.columns}")
    return df
