"""Every core query with SQL gives the rows that DuckDB gives."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from tidemark.plans import catalog


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for name in os.listdir(small):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{name}')")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_matches_sql(spark, small, db, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(catalog.oracles()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_every_sql_has_its_query():
    assert set(catalog.oracles()) <= set(catalog.queries())
