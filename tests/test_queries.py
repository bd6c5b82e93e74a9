"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import glob
import math

import duckdb
import pytest

from shelfwise.plans import library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1].removesuffix('.parquet')} AS FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.11g}"
    if isinstance(x, bool) or x is None:
        return x
    return f"{float(x):.11g}" if isinstance(x, int) and abs(x) < 2**50 else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_against_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SF)
    want = duck.execute(library.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


#: Folds in the order of lists, which tests/test_operators.py holds against examples.
WITHOUT_SQL = {"fuzzy_brand", "fuzzy_product", "resolve_product", "fn_product_evidence"}


def test_every_other_query_has_sql():
    assert set(library.QUERIES) - WITHOUT_SQL == set(library.ORACLES)
