"""Registered queries against their SQL on the smallest tables, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from seqlattice.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def sorted_rows(rows):
    return sorted((tuple(float(v) if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


def equal(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=2e-6)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, small, database, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted_rows([[r[c] for c in columns] for r in df.collect()])
    found = database.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted_rows([[r[names.index(c)] for c in columns] for r in found.fetchall()])
    assert len(got) == len(want)
    assert all(equal(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_gives_rows(spark, small, name):
    rows = QUERIES[name](spark, small).collect()
    assert rows and all(r[0] is not None for r in rows)


def test_entry(spark):
    assert entry_points.entry(spark).limit(1).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
