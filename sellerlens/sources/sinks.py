"""Output edge (S03-S05): normalise types, write marts, bundle metadata.

Inside the engine money is DecimalType and days are DateType. At the output
edge only: decimals become doubles, dates become ISO strings and `month`
columns become 'YYYY-MM' labels, as the reference's serialisation does.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize(df: DataFrame) -> DataFrame:
    exprs = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, T.DecimalType):
            c = f"CAST({c} AS DOUBLE)"
        elif isinstance(f.dataType, T.DateType):
            c = f"date_format({c}, 'yyyy-MM')" if f.name == "month" else f"CAST({c} AS STRING)"
        exprs.append(f"{c} AS `{f.name}`")
    return df.selectExpr(*exprs)


def with_refresh_stamp(df: DataFrame, refreshed_at: dt.datetime) -> DataFrame:
    """Attach the bundle's refresh time ('dd/MM/yyyy HH:mm' label, S04)."""
    return df.withColumn("updated_at", F.lit(refreshed_at.strftime("%d/%m/%Y %H:%M")))
