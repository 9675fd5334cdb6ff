"""Every query of the library's own operators against its SQL in DuckDB."""

import math

import duckdb
import pytest
from conftest import DATA

from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
#: Queries that SQL can't express; test_operators holds what they apply against plain Python. Pages of the smallest tables have no pairs.
NO_SQL = set(QUERIES) - set(ORACLES)
MAY_BE_EMPTY = {"doc2_pairs"}


@pytest.fixture(scope="module")
def duck():
    held = duckdb.connect()
    for t in TABLES:
        held.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return held


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else float(v) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, f"{DATA}/sf0.001")
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    if name not in ORACLES:
        assert name in NO_SQL and rows or name in MAY_BE_EMPTY
        return
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    at = [other.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in other.fetchall()), key=str)


def test_every_oracle_has_a_query():
    assert not set(ORACLES) - set(QUERIES)
