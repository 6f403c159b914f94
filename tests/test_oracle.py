"""Every registered query against its DuckDB oracle (row count, columns, values).

Runs at sf0.001 here; the driver repeats the check at sf0.01 (tools/compare.py).
"""

import hashlib
import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN"}

from sellerlens.plans.registry import REGISTRY

# The training-data queries have their own tests (tests/llm).
QUERIES = dict(REGISTRY)
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\\N"
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def _digest(rows):
    return hashlib.sha256("\n".join(sorted("|".join(_norm(x) for x in r) for r in rows)).encode()).hexdigest()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    srows = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = duck.sql(ORACLE[name])
    stypes = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    orows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert len(srows) == len(orows)
    assert _digest(srows) == _digest(orows)
