"""The SQL of the operators that have one, over the test tables."""

import duckdb
import pytest

from molframe.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sorted(map(tuple, df.select(*columns).collect())) == theirs
