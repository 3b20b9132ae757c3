"""Every registered query of the library proper with SQL: same rows from Spark and DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from wakeline.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(x):
    if x is None or x != x:
        return None
    return round(float(x), 4) if isinstance(x, float) else int(x) if hasattr(x, "__index__") else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    con = duck.execute(ORACLES[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = [tuple(same(r[columns.index(c)]) for c in order) for r in con.fetchall()]
    have = [tuple(same(r[c]) for c in order) for r in got.collect()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    want, have = sorted(want, key=key), sorted(have, key=key)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, abs_tol=2e-4, rel_tol=1e-6)), (name, a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
