"""Every query with an oracle against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return None if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_query(spark, duck, name):
    got = library.queries()[name](spark, SF)
    want = duck.execute(library.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    left = [[plain(r[c]) for c in order] for r in got.collect()]
    right = [[plain(r[columns.index(c)]) for c in order] for r in want.fetchall()]
    key = lambda rows: sorted(rows, key=lambda r: [x or "" for x in r])
    assert key(left) == key(right)


def test_entry(spark):
    assert library.entry(spark).count() > 0
