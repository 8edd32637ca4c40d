"""The corpus queries that SQL can express, against DuckDB; the others run and keep one row a document."""

import duckdb
import pytest

from tesserae.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(tuple(map(str, r)) for r in got.select(*names).collect())
    assert rows == sorted(tuple(map(str, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op8_pack"}))
def test_one_row_a_document(spark, name):
    got = queries.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.count() == n == got.select("doc_id").distinct().count()
