"""The queries that SQL can express, against DuckDB over the same whole tables."""

import duckdb
import pytest

from cohortry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    made = con.execute(SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(r) for r in made.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want
