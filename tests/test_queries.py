"""Every registered query with SQL against DuckDB, and the others for rows."""

import duckdb
import pytest

from strandlake import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, int | float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(cols).collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    want = sorted(repr(tuple(plain(v) for v in r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
