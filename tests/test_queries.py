"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [(p, n) for p in entry.PLANS for n in p.QUERIES]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        v = tuple(v)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return float(v) if isinstance(v, Decimal) else v


@pytest.mark.parametrize(("plan", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query(spark, duck, plan, name):
    df = plan.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in plan.ORACLES:
        got = duck.execute(plan.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
