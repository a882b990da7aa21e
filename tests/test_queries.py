"""Every registered mixture query that has SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

from mixweave.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("embeddings", "lineitem", "events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == pytest.approx(y, abs=2e-5) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)


def test_every_query_runs(spark):
    found = queries.queries()
    assert set(oracles.oracle_sql()) <= set(found)
    for name in sorted(set(found) - set(oracles.oracle_sql())):
        assert found[name](spark, SF).count() > 0
