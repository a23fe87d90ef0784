"""Every query of the engine's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

from loomwright.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float | np.floating | Decimal):
        return round(float(v), 5)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [list(want.columns).index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
