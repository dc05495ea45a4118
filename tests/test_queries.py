"""Every query with SQL gives the rows that DuckDB gives, here over the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from molframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))  # those of the training-data operators have a test of their own
def test_same_rows_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(_plain, r)) for r in df.select(*columns).collect())
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert ours == theirs


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"pos", "mol_id", "row", "fx"} <= set(rows[0].asDict())
