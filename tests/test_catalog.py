"""Each query of the usage catalogue against its SQL in DuckDB, on the smallest test tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tallyforge.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, Decimal) or isinstance(v, int) and not isinstance(v, bool):
        return str(Decimal(v).normalize())  # exact
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalog.oracle_sql()[name])
    expected = rows_of([c[0] for c in found.description], found.fetchall())
    assert got == expected
