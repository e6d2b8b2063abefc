import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [name for module in entry.FAMILIES for name in module.QUERIES]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is not None, f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_like_duckdb(spark, con, name):
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert got.columns == columns
    a, b = sorted(map(tuple, got.collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for v, w in zip(x, y):
            assert math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9) if isinstance(v, float) else v == w


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())
