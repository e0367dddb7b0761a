"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import corpus_plans, search_plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = search_plans.Q | corpus_plans.Q
SQL = search_plans.SQL | corpus_plans.SQL
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(value) -> str:
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    other = duck.sql(SQL[name])
    assert sorted(other.columns) == cols
    at = [other.columns.index(c) for c in cols]
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(other.types[other.columns.index(c)]) for c in cols}
    assert rows == sorted(tuple(shown(x[i]) for i in at) for x in other.fetchall())
