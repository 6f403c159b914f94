"""Exact ratio helpers.

Money is DecimalType and summed exactly. Ratios are formed as the IEEE double
quotient of the exact sums (each operand converted once), which makes them
reproducible across engines. Rounded money ratios (ASP) use integer cents and
integer division, so half-cent cases round half away from zero on the exact
value, never on a binary approximation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dbl(col: str | Column) -> Column:
    return _c(col).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL when den is 0 or NULL."""
    return F.try_divide(dbl(num), dbl(den))


def ratio_or_zero(num: str | Column, den: str | Column) -> Column:
    """num / den as double; 0 when den is 0 (the report-value convention)."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def pct(num: str | Column, den: str | Column) -> Column:
    """(num / den) * 100; NULL when den is 0."""
    return F.try_divide(dbl(num), dbl(den)) * F.lit(100.0)


def pct_or_zero(num: str | Column, den: str | Column) -> Column:
    return F.coalesce(pct(num, den), F.lit(0.0))


def pct_change(cur: str | Column, prev: str | Column) -> Column:
    """(cur - prev) / prev * 100; NULL when prev is 0 or NULL.

    The difference is exact (decimal or integer) before the one conversion.
    """
    c, p = _c(cur), _c(prev)
    return F.try_divide(dbl(c - p), dbl(p)) * F.lit(100.0)


def rounded_money_ratio(num: str, den: str, digits: int = 2, money_scale: int = 2) -> Column:
    """round(num / den, digits) for money `num` (scale <= money_scale), integer `den`.

    Exact on integers: with n = num in cents and d = den * 10^(money_scale - digits),
    q = (2|n| + |d|) div (2|d|), signed, over 10^digits; NULL when den is 0
    (SAFE_DIVIDE semantics). Requires digits <= money_scale.
    """
    if digits > money_scale:
        raise ValueError("digits must not exceed the money scale")
    n = f"CAST(`{num}` * {10 ** money_scale} AS BIGINT)"
    d = f"(CAST(`{den}` AS BIGINT) * {10 ** (money_scale - digits)})"
    return F.expr(
        f"CASE WHEN CAST(`{den}` AS BIGINT) = 0 THEN NULL ELSE "
        f"CAST(CAST(signum({n}) * signum({d}) AS BIGINT) * ((2 * abs({n}) + abs({d})) div (2 * abs({d}))) AS DOUBLE)"
        f" / {10 ** digits} END"
    )
