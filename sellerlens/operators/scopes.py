"""Portfolio scopes (P01) and seller labels.

A scope is what a report is computed for: the whole portfolio ("all"), a
group with more than one member, or one seller (keyed by its id as string).
All scopes are served in one pass through the bridge table (scope, seller_id):
facts are aggregated per seller first, then joined to the bridge (each seller
sits in at most three scopes, so the join has no hot key) and re-aggregated
per scope with map-side partial aggregation, which absorbs the "all" scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.functions.labels import ALL_SCOPE
from sellerlens.plans.broadcast import is_small, mark_bounded_by, max_rows_for
from sellerlens.sources.schemas import require


def multi_member_groups(members: DataFrame) -> DataFrame:
    """Groups of more than one seller, from distinct (seller_id, group_name) rows; "all" is never one."""
    return (
        members.groupBy("group_name").agg(F.count(F.lit(1)).alias("members"))
        .where((F.col("members") > 1) & (F.col("group_name") != F.lit(ALL_SCOPE))).select("group_name")
    )


def seller_scopes(portfolio: DataFrame) -> DataFrame:
    """Bridge (scope, scope_kind, seller_id): all / multi-member group / seller.

    A scope name means one thing, as in the reference report: "all" before a
    multi-member group before a seller id. So a group named "all" has no scope of
    its own, and a seller whose id is also a group's name is reached through
    that group only. Repeated portfolio rows count once.
    """
    require(portfolio, ["seller_id", "group_name"], "portfolio")
    p = portfolio.select("seller_id", "group_name").distinct()
    ids = portfolio.select("seller_id").distinct()
    multi = multi_member_groups(p)
    everyone = ids.select(F.lit(ALL_SCOPE).alias("scope"), F.lit("all").alias("scope_kind"), "seller_id")
    groups = p.join(multi, "group_name", "left_semi").select(
        F.col("group_name").alias("scope"), F.lit("group").alias("scope_kind"), "seller_id"
    )
    single = ids.select(
        F.col("seller_id").cast("string").alias("scope"), F.lit("seller").alias("scope_kind"), "seller_id"
    ).join(multi.select(F.col("group_name").alias("scope")), "scope", "left_anti").select("scope", "scope_kind", "seller_id")
    bridge = everyone.unionByName(groups).unionByName(single)
    # at most three rows per portfolio row: small when the portfolio is a third of the bound
    return mark_bounded_by(bridge, portfolio, factor=3)


def portfolio_bound(portfolio: DataFrame | None, per_seller: int) -> bool:
    """Whether `per_seller` rows of each portfolio seller are proven few enough to broadcast."""
    return portfolio is not None and is_small(portfolio, max(1, max_rows_for(portfolio) // max(1, per_seller)))


#: Tasks that a seller's rows are spread over when a large portfolio is applied to rows.
SALTS = 64


def in_portfolio_salted(df: DataFrame, portfolio: DataFrame | None, spread: str, salts: int = SALTS) -> DataFrame:
    """`in_portfolio` for rows that nothing aggregates before: joined by (seller, salt).

    The salt comes from the column `spread`, and each portfolio id is repeated for every salt, so a
    seller with a third of all rows is dealt to up to `salts` tasks.
    """
    if portfolio is None:
        return df
    ids = portfolio.select("seller_id").distinct().select(
        "seller_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(ids, ["seller_id", "_salt"], "left_semi").select(*df.columns)


def in_portfolio(df: DataFrame, portfolio: DataFrame | None, key: str = "seller_id") -> DataFrame:
    """Keep rows whose seller belongs to the portfolio (left semi join)."""
    if portfolio is None:
        return df
    ids = portfolio.select(F.col("seller_id").alias(key)).distinct()
    if is_small(portfolio):
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def split_portfolio(portfolio: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Where to apply the portfolio: (before aggregation, after aggregation).

    A portfolio proven small is semi-joined to the raw rows through a broadcast
    (no shuffle, rows dropped as early as possible). A large one is applied to
    the per-seller aggregates instead: a shuffled semi-join of raw rows would
    send every line of a hot seller to one task, while after map-side partial
    aggregation each seller contributes a handful of rows.
    """
    if portfolio is None:
        return None, None
    return (portfolio, None) if is_small(portfolio) else (None, portfolio)


def keep_portfolio_sellers(agg: DataFrame, portfolio: DataFrame | None, key: str = "seller_id") -> DataFrame:
    """Restrict per-seller aggregates to the portfolio (the 'after aggregation' side).

    An inner join with the distinct portfolio ids: equivalent to a semi-join,
    but Catalyst does not push it back below the aggregate (it would push a
    LEFT SEMI join through the aggregate onto the raw rows).
    """
    if portfolio is None:
        return agg
    ids = portfolio.select(F.col("seller_id").alias(key)).distinct()
    return agg.join(ids, key, "inner").select(*agg.columns)


def seller_label(df: DataFrame, portfolio: DataFrame, key: str = "seller_id", out: str = "seller") -> DataFrame:
    """Attach the seller's name, falling back to its id as text; of several names the least."""
    names = portfolio.groupBy(F.col("seller_id").alias("_lbl_id")).agg(F.min("name").alias("_lbl_name"))
    names = F.broadcast(names) if is_small(portfolio) else names
    joined = df.join(names, F.col(key) == F.col("_lbl_id"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_lbl_name"), F.col(key).cast("string"))).drop(
        "_lbl_id", "_lbl_name"
    )
