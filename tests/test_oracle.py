"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans import load

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return round(float(v), 5) + 0.0 if type(v).__name__ == "Decimal" else v


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-5 * max(1, abs(b)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(got.columns)
    order = [rel.columns.index(c) for c in got.columns]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    key = lambda r: [(v is None, str(round(v, 3) if isinstance(v, float) else v)) for v in r]
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want) > 0
    for a, b in zip(rows, want, strict=True):
        assert all(map(close, a, b)), (a, b)
