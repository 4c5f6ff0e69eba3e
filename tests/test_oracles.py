"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int | float):
        return repr(float(value))
    return str(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    expected = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(expected.columns, expected.fetchall())


def test_entry_ranks_entities(spark):
    df = entry.entry(spark)
    assert df.columns == ["spec_id", "entity", "value", "rank"]
    best = {r["spec_id"]: r["entity"] for r in df.filter("rank = 1").collect()}
    assert best["orders-asia-0/count"] == "NATION17"
