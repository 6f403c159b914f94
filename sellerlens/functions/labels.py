"""Fixed values that must equal the reference report's, stated plainly.

These are lookup tables and thresholds of the report semantics, not data.
Each is used through a small broadcast-free column expression (CASE chain or
map literal), so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must match the reference's report semantics)
# ---------------------------------------------------------------------------

# Logistic type classes; types in none of them count only in totals.
FF_TYPES = ("fulfillment",)
XD_TYPES = ("cross_docking", "xd_drop_off")
SS_TYPES = ("self_service", "drop_off", "default")

# Reputation level -> display label (missing level -> "-", unknown -> itself).
REPUTATION_LABELS = {
    "green_platinum": "Platinum",
    "green_gold": "Gold",
    "green": "Verde",
    "yellow": "Amarelo",
    "orange": "Laranja",
    "red": "Vermelho",
}

# Campaign type -> display label (unknown -> the type itself).
CAMPAIGN_TYPE_LABELS = {
    "TIER_1": "Tier 1",
    "TIER_3": "Tier 3",
    "SMART": "Smart",
    "CUSTOM": "On Demand",
    "PRENEGOTIATED": "Pré Neg.",
    "LIGHTNING": "Relâmpago",
    "BANK": "Banco",
    "UNHEALTHY_STOCK": "Unhealthy",
}

# Seller price qualification: rank, label, benefit eligibility (unknown: rank 9, eligible).
QUALIFICATION_RANK = {"C1": 1, "C2": 2, "C3": 3, "C4": 4, "RC": 5}
QUALIFICATION_LABELS = {
    "C1": "C1 - Saudável",
    "C2": "C2 - Alerta Preç.",
    "C3": "C3 - Crônico",
    "C4": "C4 - Quarentena",
    "RC": "RC - Recuperação",
}
QUALIFICATION_ELIGIBLE = {"C1": True, "C2": True, "C3": False, "C4": True, "RC": True}
UNKNOWN_QUALIFICATION_RANK = 9

# Price competitiveness: our price above (1 + 3%) of the rival's is non-competitive.
PRICE_TOLERANCE = "1.03"
NON_COMPETITIVE = "Nao Competitivo"
COMPETITIVE = "Competitivo"

# Report thresholds (percent).
FF_SHARE_FLAG = 50.0
BUYBOX_SHARE_FLAG = 50.0
EXPENSIVE_BANDS = (30.0, 10.0)  # > 30 high, > 10 medium, else low

# Scope holding every portfolio seller.
ALL_SCOPE = "all"

# Codes that the operators look for by default; a deployment passes its own.
HOME_SITE = "HOME"
MATCH_TYPE = "MATCH"
DEAL_PRE_AGREED = "pre_agreed"


def map_lookup(col: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """CASE chain over a small fixed mapping; `default` when no key matches."""
    c = F.col(col) if isinstance(col, str) else col
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(default) if default is not None else expr
