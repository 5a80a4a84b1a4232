"""Every registered query against the same question in SQL."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from funnelry.verification.oracles import all_oracles
from funnelry.verification.queries import all_queries

FOLDER = DATA / "sf0.001"
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        found.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return found


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())


def test_every_query_is_registered():
    assert set(all_queries()) <= set(entry.queries())
    assert set(all_oracles()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", all_queries())
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, str(FOLDER))
    expected = duck.execute(entry.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in expected.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(types)
    place = [list(types).index(c) for c in columns]
    theirs = ordered(tuple(row[i] for i in place) for row in expected.fetchall())
    assert ordered(tuple(row[c] for c in columns) for row in df.collect()) == theirs


def test_entry(spark):
    assert [tuple(r) for r in entry.entry(spark).collect()] == [(45, 43, 24, 10)]
