"""Reading and checking query documents."""

import pytest

from prismcube.errors import QueryError
from prismcube.model import AD_EVENTS as M
from prismcube.plans.spec import Aggregate, literal, parse, to_sql
from prismcube.sources import queries


def q(**parts):
    return {"select": ["day", {"SUM": "bid_price"}], "group_by": ["day"], **parts}


def test_reads_select_in_order_with_several_functions_in_one_item():
    spec = parse({"select": [{"count": "*", "Sum": "bid_price"}, "type"], "group_by": ["type"]}, M)
    assert spec.select == (Aggregate("COUNT", "*"), Aggregate("SUM", "bid_price"), "type")
    assert spec.table == "events"


@pytest.mark.parametrize(
    "query",
    [
        {},
        {"select": []},
        {"select": "day"},
        {"select": ["nope"]},
        {"select": [{"VARIANCE": "bid_price"}]},
        {"select": [{"SUM": "*"}]},
        {"select": [{"SUM": "country"}]},
        {"select": ["day"], "from": "other"},
        {"select": ["day"], "having": []},
        {"select": ["day", {"COUNT": "*"}]},
        q(where=[{"col": "day", "op": "like", "val": "x"}]),
        q(where=[{"col": "nope", "op": "eq", "val": 1}]),
        q(where=[{"op": "eq", "val": 1}]),
        q(where=[{"col": "day", "op": "between", "val": ["2024-01-01"]}]),
        q(where=[{"col": "day", "op": "lt", "val": None}]),
        q(where=[{"col": "day", "op": "in", "val": [None]}]),
        q(where=[{"col": "advertiser_id", "op": "eq", "val": "abc"}]),
        q(where=[{"col": "bid_price", "op": "eq", "val": True}]),
        q(order_by=[{"col": "day", "dir": "up"}]),
        q(order_by=[{"col": "country"}]),
        q(order_by=["day"]),
        q(limit=-1),
        q(limit="5"),
        "not json",
        [],
    ],
)
def test_refuses(query):
    with pytest.raises(QueryError):
        parse(query, M)


def test_limit_zero_is_no_limit_and_scalars_are_lists_for_in():
    spec = parse(q(limit=0, where=[{"col": "country", "op": "IN", "val": "US"}, {"col": "type", "op": "ne", "val": "click"}]), M)
    assert spec.limit is None
    assert spec.where[0].value == ("US",) and spec.where[1].op == "neq"


def test_count_star_names_are_one():
    spec = parse({"select": ["type", {"COUNT": "*"}], "group_by": ["type"], "order_by": [{"col": "count_star()", "dir": "desc"}]}, M)
    assert spec.order_by[0].item == Aggregate("COUNT", "*") and spec.aggregates == (Aggregate("COUNT", "*"),)


def test_literals_take_the_column_type():
    assert literal("50", M.columns["advertiser_id"]) == 50
    assert literal("1e2", M.columns["bid_price"]) == 100.0
    assert literal(2.5, M.columns["advertiser_id"]) == 2.5
    assert literal(5, M.columns["country"]) == "5"


def test_sql_text_escapes_values():
    text = to_sql(parse(q(where=[{"col": "country", "op": "eq", "val": "O'Hara"}]), M), M)
    assert "'O''Hara'" in text and 'sum(bid_price) as "SUM(bid_price)"' in text


def test_loads_queries_from_files_and_folders(tmp_path):
    (tmp_path / "b.json").write_text('{"select": ["day"]}')
    (tmp_path / "a.json").write_text('[{"select": ["type"]}, {"select": ["day"]}]')
    assert [n for n, _ in queries.load(folder=str(tmp_path))] == ["a_1", "a_2", "b"]
    (tmp_path / "inputs.py").write_text("queries = [{'select': ['country']}]")
    assert queries.load(folder=str(tmp_path)) == [("q1", {"select": ["country"]})]
    assert len(queries.load(file=str(tmp_path / "a.json"))) == 2
    assert queries.load()[0][0] == "q1"
    for bad in (lambda: queries.load(file=str(tmp_path / "none.json")), lambda: queries.from_text("{"), lambda: queries.load(folder=str(tmp_path / "none"))):
        with pytest.raises(QueryError):
            bad()


def test_sql_of_epoch_times_and_of_weeks_by_their_monday():
    import dataclasses

    import duckdb

    from prismcube.functions.timedims import TimeEncoding

    con = duckdb.connect()
    con.execute("create table events as select epoch_ms(t) as ts, 1.5 as bid_price from unnest([timestamp '2024-12-30 23:59:59', timestamp '2027-01-01 00:00:00']) as x(t)")
    query = {"select": ["week", "day", {"SUM": "bid_price"}], "group_by": ["week", "day"], "order_by": [{"col": "day"}]}
    for week, expected in ((TimeEncoding.ISO_WEEK, ["2024-W01", "2027-W53"]), (TimeEncoding.TRUNC, ["2024-12-30", "2026-12-28"])):
        model = dataclasses.replace(M, week=week)
        assert con.execute(to_sql(parse(query, model), model)).fetchall() == [(expected[0], "2024-12-30", 1.5), (expected[1], "2027-01-01", 1.5)]


def test_weeks_at_the_ends_of_years(spark):
    from pyspark.sql import functions as F

    from prismcube.functions.timedims import TimeEncoding, time_dim

    rows = spark.sql("select timestamp '2024-12-30 23:59:59' as t union all select timestamp '2027-01-01 00:00:00'")
    got = rows.select(time_dim("week", F.col("t")).alias("a"), time_dim("week", F.col("t"), TimeEncoding.TRUNC).alias("b")).orderBy("a").collect()
    assert [tuple(r) for r in got] == [("2024-W01", "2024-12-30"), ("2027-W53", "2026-12-28")]
