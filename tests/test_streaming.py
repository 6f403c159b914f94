"""Incremental refresh: arrivals folded in give the same marts as one batch pass over all lines, exactly once."""

import datetime as dt
import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from sellerlens.operators import marts
from sellerlens.plans.params import AS_OF
from sellerlens.sources.bindings import LogicalInputs
from sellerlens.sources.tables import load_tables
from sellerlens.streaming import LostCheckpoint, compact, refresh_seller_day, sales_marts_from_partials
from tests.conftest import SF_SMALL

BATCH_MARTS = {
    "sales_monthly": marts.sales_monthly, "sales_daily": marts.sales_daily,
    "logistics_monthly": marts.logistics_monthly, "logistics_daily": marts.logistics_daily,
    "investments_monthly": marts.investments_monthly, "investments_daily": marts.investments_daily,
}
CUT = dt.date(2001, 6, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    return LogicalInputs(load_tables(spark, SF_SMALL))


def arrive(inputs, src: str, part: int) -> None:
    rows = inputs.sales.where(F.col("closed_date") < F.lit(CUT) if part == 1 else F.col("closed_date") >= F.lit(CUT))
    rows.write.parquet(os.path.join(src, f"part{part}"))


def folders() -> tuple[str, str]:
    root = tempfile.mkdtemp(prefix="sellerlens-stream-")
    return os.path.join(root, "lines"), os.path.join(root, "partials")


def assert_exact(spark, inputs, sink: str) -> None:
    got = sales_marts_from_partials(spark, sink, AS_OF, inputs.portfolio)
    for name, build in BATCH_MARTS.items():
        want = build(inputs.sales, AS_OF, inputs.portfolio)
        assert sorted(got[name].columns) == sorted(want.columns)
        assert got[name].count() == want.count() > 0
        assert got[name].exceptAll(want.select(*got[name].columns)).count() == 0, name


@pytest.fixture(scope="module")
def streamed(spark, inputs):
    src, sink = folders()
    arrive(inputs, src, 1)
    refresh_seller_day(spark, src + "/*", sink)
    arrive(inputs, src, 2)
    refresh_seller_day(spark, src + "/*", sink)
    # a third run with nothing new adds nothing
    refresh_seller_day(spark, src + "/*", sink)
    return src, sink


def test_streamed_marts_match_batch_marts(spark, inputs, streamed):
    assert_exact(spark, inputs, streamed[1])


def test_a_lost_checkpoint_is_refused(spark, inputs, streamed, tmp_path):
    src, sink = streamed
    copy = str(tmp_path / "copy")
    shutil.copytree(sink, copy, ignore=shutil.ignore_patterns("_checkpoint"))
    with pytest.raises(LostCheckpoint):
        refresh_seller_day(spark, src + "/*", copy)
    with pytest.raises(LostCheckpoint):
        compact(spark, copy)
    assert_exact(spark, inputs, copy)  # what it has still counts once


def test_another_streams_checkpoint_is_refused(spark, inputs, streamed, tmp_path):
    src, sink = streamed
    other, mixed = str(tmp_path / "other"), str(tmp_path / "mixed")
    refresh_seller_day(spark, src + "/part1", other)
    shutil.copytree(sink, mixed, ignore=shutil.ignore_patterns("_checkpoint"))
    shutil.copytree(os.path.join(other, "_checkpoint"), os.path.join(mixed, "_checkpoint"))
    with pytest.raises(Exception, match="another stream"):
        refresh_seller_day(spark, src + "/*", mixed)
    assert_exact(spark, inputs, mixed)


def test_a_new_sink_takes_the_whole_source(spark, inputs, streamed, tmp_path):
    sink = str(tmp_path / "new")
    refresh_seller_day(spark, streamed[0] + "/*", sink, max_files_per_trigger=1)
    assert_exact(spark, inputs, sink)


def test_a_retried_batch_replaces_itself(spark, inputs, streamed, tmp_path):
    """A run that died after writing its batch and before committing it: the batch is written again."""
    src, sink = streamed
    copy = str(tmp_path / "copy")
    shutil.copytree(sink, copy)
    commits = os.path.join(copy, "_checkpoint", "commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for n in (last, f".{last}.crc"):
        if os.path.exists(os.path.join(commits, n)):
            os.remove(os.path.join(commits, n))
    refresh_seller_day(spark, src + "/*", copy)
    assert_exact(spark, inputs, copy)


def test_compaction(spark, inputs, streamed, tmp_path):
    src, sink = streamed
    copy = str(tmp_path / "copy")
    shutil.copytree(sink, copy)
    compact(spark, copy)
    assert [n for n in os.listdir(os.path.join(copy, "parts")) if n.startswith("batch=")] == []
    assert_exact(spark, inputs, copy)
    compact(spark, copy)
    refresh_seller_day(spark, src + "/*", copy)
    assert_exact(spark, inputs, copy)


def test_a_compaction_that_died_changes_nothing(spark, inputs, streamed, tmp_path):
    src, sink = streamed
    # before the base was complete
    half = str(tmp_path / "half")
    shutil.copytree(sink, half)
    os.makedirs(os.path.join(half, "base", "upto=1"))
    assert_exact(spark, inputs, half)
    # after it, with the batches still there
    both = str(tmp_path / "both")
    shutil.copytree(sink, both)
    compact(spark, both)
    shutil.copytree(os.path.join(sink, "parts"), os.path.join(both, "parts"), dirs_exist_ok=True)
    assert_exact(spark, inputs, both)
