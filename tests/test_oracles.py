"""Registered batch queries of the triage jobs against their SQL on the smallest tables."""

import collections
import decimal

import duckdb
import pytest

from sluicebox.plans import contract_queries, evidence_queries, lineage_queries, more_queries, office_queries, page_queries, queries, report_queries, storage_queries, views  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in views._TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        v = float(v)
        v = int(v) if v == int(v) else v
    return str(v)


@pytest.mark.parametrize("name", sorted(n for n in queries.ORACLE_SQL if "stream" not in n))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(queries.ORACLE_SQL[name])
    at = [list(rel.columns).index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
