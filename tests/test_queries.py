"""Every registered query with a SQL counterpart gives the same values on DuckDB."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import rows_of  # noqa: E402

from framescope.plans import registry  # noqa: E402

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, duck, name):
    frame = entry.queries()[name](spark, SMALL)
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()], None)
    assert got == rows_of(columns, result.fetchall(), None)


def test_entry(spark):
    assert "composite_score" in entry.entry(spark).columns


def test_every_query_has_sql():
    entry.queries()  # registers them
    assert set(registry.QUERIES) == set(registry.ORACLE)
