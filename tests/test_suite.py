"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone.plans import suite

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr([plain(x) for x in v]) if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    found = duck.execute(suite.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(suite.QUERIES) - set(suite.ORACLE_SQL)))
def test_runs(spark, name):
    suite.QUERIES[name](spark, SF).count()
