"""Each query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal
import math

import duckdb
import pytest
from tallyloom.plans import kinds, matching, more, payloads, queries, rules, suites  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = c.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(k) for k in cols]
    got = sorted([tuple(plain(r[k]) for k in cols) for r in df.collect()], key=repr)
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=repr)
