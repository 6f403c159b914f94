"""Helpers shared by the training-data operators: tables, names, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from sellerlens.session import checkpoint_dir
from sellerlens.sources import store

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch: texts are long, and a worker holds a batch in both directions.
BATCH_ROWS = 1_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keeps the Arrow batches of this session to BATCH_ROWS rows; a smaller setting of the cluster stays."""
    rows = int(spark.conf.get(_BATCH_CONF))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """`name`, with underscores before it until no column of the frames has it (in any case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: The intermediate tables of the run that is under way, if one keeps a list (see `scratch`).
_RUN: ContextVar[list[str] | None] = ContextVar("sellerlens_scratch", default=None)


def run_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the shared checkpoint folder (spark.checkpoint.dir on a cluster)."""
    return f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The intermediate tables that are written within this block are deleted at its end, and no others.

    Results are lazy: what is built from these tables must be written elsewhere before the block ends.
    """
    paths: list[str] = []
    before = _RUN.set(paths)
    try:
        yield
    finally:
        _RUN.reset(before)
        for path in paths:
            store.delete(spark, path)


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends there, so lost executors only re-read it."""
    spark = df.sparkSession
    bound_batches(spark)
    path = run_folder(spark, what)
    paths = _RUN.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of `written` that nothing reads any more; frames that it didn't make are left alone."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path is not None:
            store.delete(df.sparkSession, path)
