"""Every query with a DuckDB twin gives its rows."""

import duckdb
import pytest

from quillet.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return float(v) if not isinstance(v, (bool, str, type(None))) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    twin = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(twin.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[twin.columns.index(c)]) for c in names) for r in twin.fetchall()), key=repr)
    assert got == want
