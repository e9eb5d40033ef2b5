"""Every registered query of the library proper against its DuckDB text."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest

from candlewick.plans.queries import ORACLE_SQL, QUERIES


def normal(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([normal(v) for v in r] for r in df.select(columns).collect())
    c = duck.execute(ORACLE_SQL[name])
    at = {d[0]: k for k, d in enumerate(c.description)}
    assert sorted(at) == columns
    want = sorted([normal(r[at[x]]) for x in columns] for r in c.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "status" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
