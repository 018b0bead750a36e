"""Every query of the driver's tables against DuckDB at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from kinfolio import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    if name in ("stratum_quotas", "nearest_clean_pairs", "arrival_bootstrap_native"):
        pytest.skip("needs more records than this size has")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in registry.ORACLES:
        want = sorted(tuple(map(plain, r)) for r in db.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.ORACLES[name]})").fetchall())
        assert got == want
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
