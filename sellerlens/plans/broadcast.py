"""Broadcast only behind a size check.

`is_small` counts a *dimension* frame once, its rows and bytes summed in each task, and compares them with the session's
bounds. The measured size is remembered for the session under the frame's
semantic plan hash (confirmed with `sameSemantics`), so every query that joins
the same dimension - however often it is re-read - checks it once, and one
measurement answers every bound. A refresh starts with
`forget_sizes`, so a dimension that grows under a long-lived session is measured
anew; at most MEMO_FRAMES frames are remembered.
`broadcast_if_small` hints a broadcast only when the frame is proven to hold
at most `max_rows` rows and MAX_BYTES bytes; beyond that the frame is returned as
is and the join shuffles (AQE may still demote it to a broadcast from measured sizes).

Derived frames whose row count is bounded by a checked dimension (one row per
scope is bounded by the scope bridge) reuse that dimension's answer through
`broadcast_if_bounded`, so no aggregate is ever executed just to be counted.
Frames that are small by construction (one-row aggregates, calendar tables,
fixed label maps) are broadcast with `F.broadcast` directly at their use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_ROWS = 1_000_000
DEFAULT_MAX_BYTES = 256 << 20
MAX_ROWS_CONF = "spark.sellerlens.broadcast.maxRows"
MAX_BYTES_CONF = "spark.sellerlens.broadcast.maxBytes"
MEMO_FRAMES = 64
_MEMO = "_sellerlens_small"


def _setting(df: DataFrame, key: str, default: int) -> int:
    value = df.sparkSession.conf.get(key, str(default))
    return int(value) if str(value).isdigit() else default


def max_rows_for(df: DataFrame) -> int:
    """The row bound: session setting `spark.sellerlens.broadcast.maxRows`, else 1,000,000."""
    return _setting(df, MAX_ROWS_CONF, DEFAULT_MAX_ROWS)


def max_bytes_for(df: DataFrame) -> int:
    """The byte bound: session setting `spark.sellerlens.broadcast.maxBytes`, else 256 MiB."""
    return _setting(df, MAX_BYTES_CONF, DEFAULT_MAX_BYTES)


# session key -> [(semantic hash, frame, rows, bytes)]
_SIZES: dict[str, list[tuple[int, DataFrame, int, int]]] = {}


def forget_sizes(df_or_spark) -> None:
    """Measure every dimension of this session anew from now on."""
    from sellerlens.sources.tables import session_key

    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    _SIZES.pop(session_key(spark), None)


def _measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes): 8 bytes a value, and the length of texts; partial sums, so no task reads more than its own rows."""
    wide = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in wide:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    rows, total = df.select(size.alias("s")).agg(F.count("*"), F.sum("s")).first()
    return rows, total or 0


def _size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of df, from the session memo when possible."""
    from sellerlens.sources.tables import session_key

    h = df.semanticHash()
    entries = _SIZES.setdefault(session_key(df.sparkSession), [])
    for eh, frame, n, b in entries:
        if eh == h and (frame is df or frame.sameSemantics(df)):
            return n, b
    n, b = _measure(df)
    entries.append((h, df, n, b))
    del entries[:-MEMO_FRAMES]
    return n, b


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether df is proven to have at most `max_rows` rows (else the session's bound) and the session's bytes."""
    max_rows = max_rows or max_rows_for(df)
    bounded = getattr(df, _MEMO, None)
    if bounded is not None:
        source, factor = bounded
        return is_small(source, max(1, max_rows // factor))
    n, size = _size(df)
    return n <= max_rows and size <= max_bytes_for(df)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    return F.broadcast(df) if is_small(df, max_rows) else df


def broadcast_if_bounded(df: DataFrame, bound: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast `df` when `bound` (a frame with at least as many rows) is small."""
    return F.broadcast(df) if is_small(bound, max_rows) else df


def mark_bounded_by(derived: DataFrame, source: DataFrame, factor: int) -> DataFrame:
    """Record that `derived` has at most `factor` x the rows of `source`.

    Its size check is then answered by checking `source` against max_rows / factor,
    so no extra job runs for the derived frame.
    """
    setattr(derived, _MEMO, (source, factor))
    return derived
