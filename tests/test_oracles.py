"""Every registered query against its SQL on the smallest data set."""

import os

import duckdb
import pytest

from wardlake.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("WARDLAKE_DATA", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def tidy(rows):
    values = [tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in rows]
    return sorted(values, key=lambda row: tuple((x is None, str(x)) for x in row))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, FOLDER)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert tidy(df.select(*columns).collect()) == tidy([tuple(r[i] for i in order) for r in result.fetchall()])


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0
