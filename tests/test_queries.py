"""Every registered query of the engine against its SQL in an independent engine."""

import math
import os

import duckdb
import pytest

from tracemill import queries_records, queries_rules, queries_state  # noqa: F401, they add to QUERIES
from tracemill.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, other, name):
    df = QUERIES[name](spark, SF)
    found = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert len(df.columns) > 0
        return
    wanted = other.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert found == rows(wanted.columns, wanted.fetchall())


def test_oracles_belong_to_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(QUERIES) >= 50


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
