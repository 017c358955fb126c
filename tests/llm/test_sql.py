"""Registered queries against their SQL in DuckDB, on a table as they read it."""

from pathlib import Path

import duckdb
import pytest

from prismcube.llm import queries


def as_text(value):
    return "NULL" if value is None else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, small, name):
    con = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    frame = queries.QUERIES[name](spark, small)
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    assert sorted([as_text(r[c]) for c in order] for r in frame.collect()) == sorted([as_text(r[columns.index(c)]) for c in order] for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs_on_the_smallest_tables(spark, small, name):
    frame = queries.QUERIES[name](spark, small)
    assert frame.count() > 0
