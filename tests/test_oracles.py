"""Each named query against its SQL oracle, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else v + 0.0
        return v

    def key(row):
        return tuple((v is not None, "n" if isinstance(v, (int, float)) else type(v).__name__, v if v is not None else 0) for v in row)

    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(rows, got.columns) == ordered(cur.fetchall(), columns)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
