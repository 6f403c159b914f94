"""The daily refresh of the additive sales marts as an incremental stream.

The reference recomputes its marts from scratch once a day. Here new
order-line files (logical `sales` schema) landing in a folder are folded in
with Structured Streaming, run as an available-now trigger (process what has
arrived, then stop - a scheduled batch with exactly-once bookkeeping):

  readStream(parquet, schema) -> countable lines -> foreachBatch:
      per-(day, seller) partial sums of every sales measure in the
      micro-batch, written to <sink>/parts/batch=<id> with overwrite (a retried
      batch replaces its own output, so reprocessing after a lost executor
      or driver is idempotent)

The sink holds everything the stream knows: the checkpoint (offsets, committed
batches) is <sink>/_checkpoint, so a sink and its offsets cannot part. The id of
the stream, which Spark keeps in its checkpoint, is written beside the partials;
a sink with partials whose checkpoint is gone, or is another stream's, is
refused, because reading the source again would count it twice.

`compact` sums all committed batches into one table, <sink>/base/upto=<id>.
Readers take the newest complete base and the batches after it, so a compaction
that dies half-way changes nothing.

The read side sums the partials per (day, seller), which gives `seller_day`
rows - exact decimal sums, so the same values as one pass over all lines - and
the six additive sales marts (Q01-Q03, Q05, Q06, Q08) roll up from them with
`marts.sales_marts_from_days`.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sellerlens.functions.dates import two_year_window
from sellerlens.functions.labels import DEAL_PRE_AGREED
from sellerlens.operators.marts import SALES_MEASURES, sales_line_measures, sales_marts_from_days
from sellerlens.operators.scopes import keep_portfolio_sellers
from sellerlens.sources import store
from sellerlens.sources.schemas import SALES

STREAM_ID = "_stream_id"


class LostCheckpoint(RuntimeError):
    """The sink has partial sums that its checkpoint does not account for."""


def _partials(batch: DataFrame, pre_agreed_code: str) -> DataFrame:
    m = sales_line_measures(pre_agreed_code)
    return batch.where(F.col("gmv_flag")).groupBy(F.col("closed_date").alias("day"), "seller_id").agg(
        *[F.sum(e).alias(n) for n, e in m.items()]
    )


def _batches(spark: SparkSession, sink_dir: str) -> list[int]:
    """The ids of complete batches."""
    found = [n for n in store.names(spark, f"{sink_dir}/parts") if n.startswith("batch=")]
    return sorted(int(n[6:]) for n in found if store.exists(spark, f"{sink_dir}/parts/{n}/_SUCCESS"))


def _base(spark: SparkSession, sink_dir: str) -> int | None:
    """The last batch in the newest complete base."""
    found = [int(n[5:]) for n in store.names(spark, f"{sink_dir}/base")
             if n.startswith("upto=") and store.exists(spark, f"{sink_dir}/base/{n}/_SUCCESS")]
    return max(found, default=None)


def _check(spark: SparkSession, sink_dir: str) -> None:
    counted = _batches(spark, sink_dir) or _base(spark, sink_dir) is not None
    if counted and not store.exists(spark, f"{sink_dir}/_checkpoint/metadata"):
        raise LostCheckpoint(f"{sink_dir} has partial sums but no checkpoint; start a new sink from the whole source")


def refresh_seller_day(spark: SparkSession, source_dir: str, sink_dir: str, max_files_per_trigger: int | None = None,
                       pre_agreed_code: str = DEAL_PRE_AGREED) -> None:
    """Fold every order-line file that arrived since the last run into the partials of `sink_dir`."""
    _check(spark, sink_dir)
    reader = spark.readStream.schema(SALES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    stream = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        marker = f"{sink_dir}/{STREAM_ID}"
        if not store.exists(spark, marker):
            store.replace_text(spark, marker, own)
        elif store.read_text(spark, marker) != own:
            raise LostCheckpoint(f"{sink_dir} belongs to another stream than its checkpoint")
        _partials(batch, pre_agreed_code).write.mode("overwrite").parquet(f"{sink_dir}/parts/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{sink_dir}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _partial_sums(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All partial rows that count: the newest base and the batches after it."""
    base = _base(spark, sink_dir)
    paths = [f"{sink_dir}/parts/batch={b}" for b in _batches(spark, sink_dir) if base is None or b > base]
    if base is not None:
        paths.append(f"{sink_dir}/base/upto={base}")
    if not paths:
        raise FileNotFoundError(f"{sink_dir} has no partial sums")
    return spark.read.parquet(*paths)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("day", "seller_id").agg(*[F.sum(n).cast(parts.schema[n].dataType).alias(n) for n in SALES_MEASURES])


def compact(spark: SparkSession, sink_dir: str) -> None:
    """Sum all batches so far into one base, then delete what it replaces.

    Run it between refreshes: the last batch written is a committed one then.
    """
    _check(spark, sink_dir)
    batches, old = _batches(spark, sink_dir), _base(spark, sink_dir)
    if not batches or batches[-1] == old:
        return
    _summed(_partial_sums(spark, sink_dir)).write.mode("overwrite").parquet(f"{sink_dir}/base/upto={batches[-1]}")
    for b in batches:
        store.delete(spark, f"{sink_dir}/parts/batch={b}")
    if old is not None:
        store.delete(spark, f"{sink_dir}/base/upto={old}")


def seller_day_from_partials(spark: SparkSession, sink_dir: str, as_of: dt.date,
                             portfolio: DataFrame | None = None) -> DataFrame:
    """`seller_day` rows over the two-year window from the accumulated partial sums."""
    parts = _partial_sums(spark, sink_dir).where(two_year_window(as_of).predicate("day"))
    return keep_portfolio_sellers(_summed(parts), portfolio)


def sales_marts_from_partials(spark: SparkSession, sink_dir: str, as_of: dt.date,
                              portfolio: DataFrame | None = None) -> dict[str, DataFrame]:
    """Q01, Q02, Q03, Q05, Q06, Q08 from the accumulated partial sums."""
    return sales_marts_from_days(seller_day_from_partials(spark, sink_dir, as_of, portfolio), as_of)
