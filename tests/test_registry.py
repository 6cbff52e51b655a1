"""Every registered query with SQL agrees with it on the smallest tables; the others give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from umbra.plans import REGISTRY

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if os.path.exists(path := f"{FOLDER}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (bool, int)) else round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_agrees_with_sql(spark, sql, name):
    got = REGISTRY.queries[name](spark, FOLDER)
    want = sql.execute(REGISTRY.sql[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(columns, want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and abs(p - q) <= 2e-5 * max(1, abs(q)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_gives_rows(spark, name):
    assert REGISTRY.queries[name](spark, FOLDER).count() > 0
