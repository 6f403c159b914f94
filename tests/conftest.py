import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sellerlens.session import get_spark

    import tempfile

    # the event log (in a scratch folder) gives per-task metrics to the skew tests
    log_dir = tempfile.mkdtemp(prefix="sellerlens-events-")
    s = get_spark("local[4]", app_name="sellerlens-tests", shuffle_partitions=4,
                  extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                         "spark.eventLog.compress": "false"})
    yield s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split():
        path = os.path.join(SF_SMALL, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con
