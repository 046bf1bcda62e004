"""Every registered query that has SQL gives the same rows as DuckDB."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return getattr(value, "isoformat", lambda: value)()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_the_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    theirs = sorted((tuple(plain(v) for v in (row[columns.index(c)] for c in order)) for row in want.fetchall()), key=str)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=str)
    assert len(ours) == len(theirs)
    assert ours == theirs


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
