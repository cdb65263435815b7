"""Every registered query with an oracle against DuckDB on the smallest tables; the others must run and keep their shape."""

import math
import os
from collections import Counter

import duckdb
import pytest

from bitloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    yield con
    con.close()


def plain(v):
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.sql(registry.ORACLES[name])
    assert sorted(found.columns) == names
    ours = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    theirs = Counter(tuple(plain(v) for v in r) for r in found.select(*names).fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_without_oracle(spark, name):
    assert registry.QUERIES[name](spark, SF).collect()
