"""Every named query with SQL is run on the smallest tables and compared with DuckDB, value by value."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    yield con
    con.close()


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "missing" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    expected = duck.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected_rows = sorted(tuple(shown(r[i]) for i in places) for r in expected.fetchall())
    got_rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert len(got_rows) == len(expected_rows)
    assert got_rows == expected_rows
    assert got_rows or name == "dedup_doi"


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    rows = {r.decision: r.n for r in entry_points.entry(spark).collect()}
    assert set(rows) == {"include", "exclude", "uncertain"} and sum(rows.values()) > 100
