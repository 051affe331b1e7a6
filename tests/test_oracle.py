"""Every registered query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from tests.conftest import DATA
from textloom.plans import catalogue


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[: -len('.parquet')]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(records):
    key = lambda r: [(v is None, str(v)) for v in r]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(([norm(v) for v in r] for r in records), key=key)


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = rows([r[c] for c in cols] for r in df.collect())
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in result.description]
    want = rows([dict(zip(names, r, strict=True))[c] for c in cols] for r in result.fetchall())
    assert sorted(names) == cols
    assert got == want
