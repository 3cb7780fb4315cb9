"""Every query of the library gives the rows of its SQL."""

import math

import duckdb
import pytest

from pagewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ALL))
def test_query(spark, data, duck, name):
    query, sql = catalog.ALL[name]
    found = query(spark, data)
    columns = sorted(found.columns)
    rows = sorted([cell(r[c]) for c in columns] for r in found.collect())
    assert rows or name in ("cache_eviction", "dup_ids")
    if sql:
        expected = duck.sql(sql)
        at = {c: i for i, c in enumerate(expected.columns)}
        assert sorted(at) == columns
        assert rows == sorted([cell(r[at[c]]) for c in columns] for r in expected.fetchall())
