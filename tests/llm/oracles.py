"""Rows of a query and of its SQL, ready to compare."""

import math
from pathlib import Path

import duckdb


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, list) else value


def both(spark, query, sql, sf, tables):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in tables:
        place = Path(f"{sf}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{place}{'/*.parquet' if place.is_dir() else ''}'")
    df, found = query(spark, sf), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    rows = [[plain(r[c]) for c in columns] for r in df.collect()]
    other = [[plain(r[found.columns.index(c)]) for c in columns] for r in found.fetchall()]
    return sorted(rows, key=str), sorted(other, key=str)


def assert_equal(spark, query, sql, sf, tables):
    got, want = both(spark, query, sql, sf, tables)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True)), (a, b)
    return got
