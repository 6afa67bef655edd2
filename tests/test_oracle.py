"""Every query with SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidebar.plans import extra_queries, family_queries, mining_queries  # noqa: F401
from tidebar.plans.queries import ORACLE, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries that depend on places in a symbol's bars, which the smallest tables have too few of.
PLACED = "portfolio_schedule first_day_stops forward_outcomes strict_next_bar entry_at_or_after stock_mentions stock_news_scores pattern_division".split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in rows)


def connected(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def duck():
    return connected(DATA)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables here")
@pytest.mark.parametrize("name", PLACED)
def test_same_as_sql_on_more_bars(spark, name):
    df = QUERIES[name](spark, LARGER)
    found = connected(LARGER).execute(ORACLE[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())
