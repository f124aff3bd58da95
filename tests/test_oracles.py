"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from gleaner import registry

DATA = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
OTHERS = sorted(set(registry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    result = con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(result.columns) == columns
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [result.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", OTHERS)
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and df.count() > 0
