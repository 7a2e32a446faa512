"""Every query with SQL against an independent engine, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from tessera.suite import base, meaning, orders, star  # noqa: E402, F401

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query(spark, duck, name):
    got = base.QUERIES[name](spark, SF)
    want = duck.sql(base.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    assert a == b


def test_every_query_has_sql():
    assert set(base.QUERIES) == set(base.ORACLE)
