"""Lazy access to the physical source tables (one parquet dataset per table).

Nothing is read here: each attribute is a `spark.read.parquet` DataFrame, so
column pruning and filter pushdown are decided by Catalyst per query.

Parquet schema inference runs a (small) Spark job per read. The inferred
schema of a path is remembered for the session, so later queries over the
same table pass it explicitly and start without that job.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SOURCE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def session_key(spark: SparkSession) -> str:
    """Identity of the session, for per-session memos."""
    try:
        return str(spark._jsparkSession.sessionUUID())
    except Exception:  # noqa: BLE001 - other session kinds: fall back to the Python object
        return str(id(spark))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    key = (session_key(spark), path)
    schema = _SCHEMAS.get(key)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[key] = df.schema
    return df


@dataclass
class SourceTables:
    spark: SparkSession
    root: str
    _cache: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def path(self, name: str) -> str:
        single = os.path.join(self.root, f"{name}.parquet")
        return single if os.path.exists(single) or "://" in self.root else os.path.join(self.root, name)

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = read_parquet(self.spark, self.path(name))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in SOURCE_TABLES:
            return self.table(name)
        raise AttributeError(name)


def load_tables(spark: SparkSession, root: str) -> SourceTables:
    return SourceTables(spark, root)
