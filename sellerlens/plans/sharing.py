"""One executed subplan for several uses of a table in one plan, without writing it.

Spark runs equal exchanges of a plan once, but Catalyst makes the uses of a table unequal: it pushes each use's
filters and columns down into its own copy. `in_plan` gathers the rows of a key into one list of whole rows and
unfolds it again. Nothing is pushed below that list, so the exchange under it is equal for every use, and all but
the first are planned as a reused exchange. The frame stays lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_plan(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`df`, for use at several places of one plan. A key's rows lie in one list, so `keys` must bound them
    (a seller's days of a window, the days of an item)."""
    held = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.collect_list(F.struct(*df.columns)).alias("_rows"))
    return held.select(F.explode("_rows").alias("_row")).select("_row.*")
