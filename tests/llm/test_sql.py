"""Operators that SQL can express give DuckDB's rows on the smallest tables."""

import os

import pytest

from regionspark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, got.select(*names).toLocalIterator())) == sorted(str(_row(names, r)) for r in want.fetchall())


def _row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values)))
