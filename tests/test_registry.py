"""Every registered query against its oracle on the smallest tables, and the driver contract."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from skirmish.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list) else round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    found = duck.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    want = sorted(([plain(r[found.columns.index(c)]) for c in columns] for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=2e-5) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 101
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
