"""Every query with SQL against DuckDB on the same files."""

import datetime
import math
import os

import duckdb
import pytest

from cohortry.plans.catalogue import QUERIES, SQL

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert got
        return
    made = con.execute(SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in made.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (x.replace(".", "").replace("-", "").replace("e", "").isdigit() and abs(float(x) - float(y)) <= 1e-6 * max(1, abs(float(y)))) for x, y in zip(a, b, strict=True)), (a, b)
