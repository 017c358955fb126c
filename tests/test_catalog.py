"""Registered queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from prismcube import catalog, warehouse_catalog

QUERIES, SQL = {**catalog.QUERIES, **warehouse_catalog.QUERIES}, {**catalog.SQL, **warehouse_catalog.SQL}


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(tables).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def as_text(value):
    return "NULL" if value is None or value != value else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, tables, name):
    frame = QUERIES[name](spark, tables)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    expected = sorted([as_text(r[columns.index(c)]) for c in order] for r in cursor.fetchall())
    assert sorted([as_text(r[c]) for c in order] for r in frame.collect()) == expected


def test_a_warehouse_follows_its_events(spark, small, tmp_path):
    """Other events under the same path are another warehouse."""
    name, n = "w_christmas_minutes", []
    for copies in (1, 3):
        duckdb.sql(f"copy (select event_id + 1000000 * k as event_id, * exclude (event_id) from '{small}/events.parquet', range({copies}) as t(k)) to '{tmp_path}/events.parquet'")
        con = duckdb.connect()
        con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
        got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
        assert got == sorted(con.execute(SQL[name]).fetchall())
        n.append(sum(r[1] for r in got))
    assert n[1] == 3 * n[0] > 0


def test_entry_and_registration(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engine_imports_nothing_of_the_training_data_operators():
    root = Path(catalog.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "prismcube.llm" not in path.read_text(), path
