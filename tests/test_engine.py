"""Null rules, routes, rollups and the warehouse, on small frames."""

import datetime as dt
import itertools
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismcube.engine import Engine
from prismcube.errors import QueryError, WarehouseError
from prismcube.model import AD_EVENTS as M
from prismcube.model import COMBINED, CORE, RollupDef
from prismcube.operators import profile, rollups
from prismcube.plans.router import DETAIL
from prismcube.plans.spec import parse
from prismcube.store import COMPACT, Warehouse
from prismcube.streaming.incremental import keep_current, windowed_state


def millis(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp() * 1000)


ROWS = [
    # ts, type, auction, advertiser, publisher, bid, user, total, country
    (millis("2024-01-01 09:05"), "impression", "a", 1, 10, 10.5, 100, None, "US"),
    (millis("2024-01-01 09:05"), "impression", "b", 1, 11, None, 101, None, "US"),
    (millis("2024-01-01 23:59"), "impression", "c", 2, 10, 20.25, 102, None, None),
    (millis("2024-02-29 00:00"), "click", "d", 2, 11, None, 103, None, "JP"),
    (millis("2024-02-29 00:01"), "click", "e", None, 10, None, 100, None, "JP"),
    (millis("2024-12-30 08:00"), "purchase", "f", 3, None, None, 104, 99.0, "NA"),
    (millis("2024-12-31 08:30"), "purchase", "g", 3, 12, None, 104, 1.0, None),
    (millis("2024-12-31 08:30"), "serve", "h", 1, 12, None, None, None, "US"),
    (millis("2024-12-31 08:30"), "serve", "h", 1, 12, None, None, None, "US"),
    (None, "serve", "i", 1, 12, None, None, None, "US"),
]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, M.schema).cache()


@pytest.fixture(scope="module")
def engine(spark, events):
    e = Engine(spark, M)
    e._events = events
    for r in M.rollups:
        frame = rollups.build(events, r, M).cache()
        e.add_rollup(r, frame, frame.count())
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def same(a, b):
    near = lambda x, y: x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9)
    return len(a) == len(b) and all(len(x) == len(y) and all(map(near, x, y)) for x, y in zip(a, b))


def test_sums_and_averages_of_no_values_are_null_counts_are_zero(engine):
    query = {"select": ["type", {"SUM": "bid_price"}, {"AVG": "bid_price"}, {"COUNT": "bid_price"}, {"COUNT": "*"}, {"MIN": "bid_price"}], "where": [{"col": "type", "op": "eq", "val": "click"}], "group_by": ["type"]}
    for route in ("detail", "rollup", "day_type", "country_type"):
        assert rows(engine.query(query, route)) == [("click", None, None, 0, 2, None)]


def test_global_aggregates_are_one_row_even_of_nothing(engine):
    query = {"select": [{"SUM": "bid_price"}, {"COUNT": "*"}, {"COUNT": "bid_price"}]}
    nothing = {**query, "where": [{"col": "country", "op": "eq", "val": "ZZ"}]}
    for route in ("detail", "rollup"):
        assert rows(engine.query(query, route)) == [(30.75, 10, 2)]
        assert rows(engine.query(nothing, route)) == [(None, 0, 0)]


def test_null_keys_are_one_group_and_sort_last(engine):
    query = {"select": ["country", {"COUNT": "*"}], "group_by": ["country"], "order_by": [{"col": "country", "dir": "desc"}]}
    for route in ("detail", "rollup"):
        assert [tuple(r) for r in engine.query(query, route).collect()] == [("US", 5), ("NA", 1), ("JP", 2), (None, 2)]


def test_select_order_distinct_groups_raw_rows_and_limits(engine):
    q = engine.query({"select": [{"COUNT": "*"}, "type"], "group_by": ["type", "country"]})
    assert q.columns == ["COUNT(*)", "type"] and q.count() == 6
    assert rows(engine.query({"select": ["type"], "group_by": ["type"]})) == [("click",), ("impression",), ("purchase",), ("serve",)]
    assert engine.query({"select": ["type", "day"]}).count() == 10
    assert rows(engine.query({"select": ["auction_id"], "order_by": [{"col": "auction_id", "dir": "desc"}], "limit": 2})) == [("h",), ("i",)]


def test_order_by_an_aggregate_that_is_not_selected(engine):
    query = {"select": ["country"], "group_by": ["country"], "order_by": [{"col": "COUNT(*)", "dir": "desc"}, {"col": "country"}]}
    for route in ("detail", "rollup"):
        assert [r[0] for r in engine.query(query, route).collect()] == ["US", "JP", None, "NA"]


def test_weeks_join_calendar_year_and_iso_number(engine):
    query = {"select": ["week", {"COUNT": "*"}], "group_by": ["week"], "where": [{"col": "type", "op": "neq", "val": "click"}]}
    expected = [("2024-W01", 7), (None, 1)]
    for route in ("detail", "week_type", "day_type", "hour_type", "minute_type"):
        assert rows(engine.query(query, route)) == sorted(expected, key=repr)


def test_all_operators_work_on_calendar_dimensions(engine):
    for op, val in (("gte", "2024-12-30"), ("in", ["2024-12-30", "2024-12-31"]), ("between", ["2024-12-01", "2024-12-31"]), ("neq", "2024-01-01")):
        query = {"select": [{"COUNT": "*"}], "where": [{"col": "day", "op": op, "val": val}]}
        assert rows(engine.query(query, "detail")) == rows(engine.query(query, "day_type")) == rows(engine.query(query, "minute_type"))


def test_count_star_name_is_an_option(spark, events):
    e = Engine(spark, M, count_star="count_star()")
    e._events = events
    assert e.query({"select": ["type", {"COUNT": "*"}], "group_by": ["type"]}).columns == ["type", "count_star()"]


def test_the_text_null_is_text_unless_asked(spark, events):
    query = {"select": [{"COUNT": "*"}], "where": [{"col": "country", "op": "eq", "val": "NULL"}]}
    for null_text, n in ((False, 0), (True, 2)):
        e = Engine(spark, M, null_text=null_text)
        e._events = events
        assert e.query(query).first()[0] == n


def test_presets_name_rollups():
    assert len(CORE) == 7 and {M.rollup(n).name for n in (*CORE, *COMBINED)} == {*CORE, *COMBINED}


def test_routes_to_the_smallest_covering_rollup(engine):
    route = lambda **q: engine.route({"select": [{"SUM": "bid_price"}], **q})
    assert route(where=[{"col": "type", "op": "eq", "val": "click"}]).table in ("week_type", "country_type")
    assert route(group_by=["day"], select=["day", {"SUM": "bid_price"}], where=[{"col": "country", "op": "eq", "val": "US"}]).table == "day_country_type"
    assert route(group_by=["minute"], select=["minute", {"SUM": "bid_price"}], where=[{"col": "country", "op": "eq", "val": "US"}]).table == DETAIL
    assert route(select=[{"COUNT": "user_id"}]).table == DETAIL
    assert route(select=[{"MEDIAN": "bid_price"}]).table == DETAIL
    got = route(group_by=["minute", "day"], select=["minute", "day", {"SUM": "bid_price"}])
    assert got.table == "minute_type" and got.derived == {"day": "minute"} and "country_type" in got.rejected
    with pytest.raises(QueryError):
        engine.query({"select": [{"COUNT": "user_id"}]}, "rollup")
    with pytest.raises(QueryError):
        engine.query({"select": [{"COUNT": "*"}], "where": [{"col": "country", "op": "eq", "val": "US"}]}, "day_type")


def test_three_ways_to_build_and_two_to_merge_agree(events):
    direct = {r.name: rows(rollups.build(events, r, M)) for r in M.rollups}
    for built in (rollups.build_by_grouping_sets(events, M.rollups, M), rollups.build_lattice(events, M.rollups, M)):
        for name, frame in built.items():
            assert same(rows(frame.select(rollups.build(events, M.rollup(name), M).columns)), direct[name]), name
    d = M.rollup("country_type")
    halves = [rollups.build(events.where(f"coalesce(advertiser_id, 0) % 2 = {i}"), d, M) for i in (0, 1)]
    assert same(rows(rollups.merge(halves, d, M)), direct["country_type"])
    assert same(rows(rollups.merge_by_join(*halves, d, M)), direct["country_type"])


def test_merge_adds_counts_of_shared_keys_and_keeps_the_others(spark):
    d, s = RollupDef("t", ("advertiser_id", "type")), "advertiser_id int, type string, bid_price double, total_price double, ts long"
    frame = lambda data: rollups.build(spark.createDataFrame([(k, t, None, None, 0) for k, t, n in data for _ in range(n)], s), d, M)
    a, b = frame([(1, "serve", 2), (2, "serve", 3), (None, "serve", 1)]), frame([(2, "serve", 1), (4, "serve", 2), (None, "serve", 2)])
    for out in (rollups.merge([a, b], d, M), rollups.merge_by_join(a, b, d, M)):
        assert {(r.advertiser_id, r.row_count, r.bid_price_sum, r.bid_price_min) for r in out.collect()} == {(1, 2, None, None), (2, 4, None, None), (4, 2, None, None), (None, 3, None, None)}


DIMS = ("type", "country", "day", "hour", "week", "advertiser_id", "publisher_id")
VALUES = {"type": ["click", "impression", "zz"], "country": ["US", "NA", None], "day": ["2024-01-01", "2024-12-31"], "hour": ["2024-01-01 09:00"], "week": ["2024-W01"], "advertiser_id": [1, 2], "publisher_id": [10, 12]}
conditions = st.sampled_from(DIMS).flatmap(lambda d: st.tuples(st.just(d), st.sampled_from(["eq", "neq", "lte", "gt", "in"]), st.sampled_from(VALUES[d]))).filter(lambda c: c[2] is not None or c[1] in ("eq", "neq"))
aggregates = st.tuples(st.sampled_from(["SUM", "AVG", "COUNT", "MIN", "MAX"]), st.sampled_from(["bid_price", "total_price"]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(groups=st.lists(st.sampled_from(DIMS), unique=True, max_size=2), where=st.lists(conditions, max_size=2), wanted=st.lists(aggregates, min_size=1, max_size=3, unique=True))
def test_every_route_gives_the_same_answer(engine, groups, where, wanted):
    query = {"select": [*groups, *({f: c} for f, c in wanted), {"COUNT": "*"}], "group_by": groups, "where": [{"col": c, "op": o, "val": v} for c, o, v in where]}
    route = engine.route(query)
    expected = rows(engine.query(query, "detail"))
    for name in route.candidates[:2]:
        assert same(rows(engine.query(query, name)), expected), name


def test_warehouse_round_trip_append_and_validation(spark, events, tmp_path):
    path = str(tmp_path / "house")
    e = Engine(spark, M, path)
    sizes = e.prepare(events, partition_minutes=True)
    assert set(sizes) == {r.name for r in M.rollups}
    again = Engine(spark, M, path)
    assert all(ok for _, ok, _ in again.validate())
    query = {"select": ["country", {"SUM": "bid_price"}, {"COUNT": "*"}], "group_by": ["country"]}
    assert same(rows(again.query(query, "rollup")), rows(again.query(query, "detail")))
    assert again.warehouse.partition_keys("minute_type")[0] in (None, "2024-01-01")
    assert again.warehouse.partition("minute_type", "2024-02-29").count() == 2
    assert {r.name for r in again.warehouse.info().collect()} >= {"detail", "day_type"}
    assert again.preload() == len(M.rollups)
    again.append(events)
    doubled = {k: (s, n) for k, s, n in rows(again.query(query, "rollup"))}
    assert doubled["US"] == (21.0, 10) and same(rows(again.query(query, "rollup")), rows(again.query(query, "detail")))
    assert again.query({"select": [{"COUNT": "*"}], "where": [{"col": "day", "op": "eq", "val": "2024-02-29"}]}, "minute_type").first()[0] == 4
    with pytest.raises(WarehouseError):
        again.warehouse.rollup("nope")
    with pytest.raises(WarehouseError):
        e.prepare(events, ["day_type"], compression="rar")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(WarehouseError):
            Warehouse(spark, path, M)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_partition_filter_reaches_the_scan(spark, events, tmp_path):
    e = Engine(spark, M, str(tmp_path / "house"))
    e.prepare(events, ["minute_type"], partition_minutes=True)
    frame = e.warehouse.stored("minute_type").where("day = '2024-02-29'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    detail = e.query({"select": ["type"], "where": [{"col": "country", "op": "eq", "val": "US"}]}, "detail")
    plan = detail._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(country,US)" in plan and "ReadSchema: struct<type:string,country:string>" in plan


def test_batch_isolates_failures_and_writes_files(engine, tmp_path):
    done = engine.run_batch([("good", {"select": [{"COUNT": "*"}]}), ("bad", {"select": ["nope"]})], str(tmp_path))
    assert [o.error is None for o in done] == [True, False]
    assert (tmp_path / "good.csv").read_text() == "COUNT(*)\n10\n" or (tmp_path / "good.csv").read_text().split() == ["COUNT(*)", "10"]
    assert (tmp_path / "timing_results.json").exists() and not (tmp_path / "bad.csv").exists()


def test_stream_keeps_rollups_current(spark, events, tmp_path):
    e = Engine(spark, M, str(tmp_path / "house"))
    e.prepare(events.limit(0), ["day_type"])
    source = tmp_path / "in"
    events.coalesce(1).write.parquet(str(source))
    q = keep_current(e, spark.readStream.schema(M.schema).parquet(str(source)), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    assert e.query({"select": [{"COUNT": "*"}]}, "day_type").first()[0] == 10
    q = keep_current(e, spark.readStream.schema(M.schema).parquet(str(source)), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert e.query({"select": [{"COUNT": "*"}]}, "day_type").first()[0] == 10


def test_a_second_stream_is_added_and_a_failed_append_leaves_no_trace(spark, events, tmp_path, monkeypatch):
    path = str(tmp_path / "house")
    e = Engine(spark, M, path)
    e.prepare(events, ["day_type", "country_type"])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(M.schema).parquet(str(tmp_path / "in"))
    count = {"select": [{"COUNT": "*"}]}
    for n, check in enumerate(("one", "two", "two"), 2):
        keep_current(e, source, str(tmp_path / check)).awaitTermination(120)
        assert e.query(count, "day_type").first()[0] == e.query(count, "detail").first()[0] == 10 * min(n, 3)
    write, calls = Warehouse.write_rollup, []

    def failing(self, definition, *rest, **named):
        calls.append(definition.name)
        if definition.name == "country_type":
            raise OSError("the disk is full")
        return write(self, definition, *rest, **named)

    monkeypatch.setattr(Warehouse, "write_rollup", failing)
    with pytest.raises(OSError):
        e.append(events, ("loader", 1))
    monkeypatch.undo()
    assert "day_type" in calls
    for fresh in (Engine(spark, M, path), e):
        fresh.warehouse.refresh()
        assert {fresh.query(count, r).first()[0] for r in ("day_type", "country_type", "detail")} == {30}
    assert e.append(events, ("loader", 1)) and not e.append(events, ("loader", 1))
    assert {e.query(count, r).first()[0] for r in ("day_type", "country_type", "detail")} == {40}
    assert e.warehouse.vacuum() > 0
    assert {e.query(count, r).first()[0] for r in ("day_type", "country_type", "detail")} == {40}


def test_many_appends_are_merged_into_one_part_and_writers_notice_each_other(spark, events, tmp_path):
    path = str(tmp_path / "house")
    e = Engine(spark, M, path)
    e.prepare(events, ["country_type"], detail=False)
    other = Engine(spark, M, path)
    for _ in range(COMPACT):
        e.append(events)
    assert len(e.warehouse.manifest.rollups["country_type"].parts) < COMPACT
    assert e.query({"select": [{"COUNT": "*"}]}, "country_type").first()[0] == 10 * (COMPACT + 1)
    with pytest.raises(WarehouseError):
        other.warehouse.save()


def test_windowed_groups_come_out_once(spark, events, tmp_path):
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = events.limit(1).withColumn("ts", F.lit(4102444800000)) if M.epoch_millis else events.limit(1).withColumn("ts", F.lit("2100-01-01").cast(M.schema["ts"].dataType))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    e = Engine.frames(spark, events, M)
    for name in ("day_type", "week_type"):
        stream = windowed_state(e, spark.readStream.schema(M.schema).parquet(str(tmp_path / "in")), name)
        stream.writeStream.format("memory").queryName(f"w_{name}").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
        got = [r for r in spark.table(f"w_{name}").collect() if not r[0].startswith("2100")]
        expected = rollups.build(events.where("ts is not null"), M.rollup(name), M).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, expected), key=repr)
    with pytest.raises(QueryError):
        windowed_state(e, events, "country_type")


def test_profiles(events):
    got = {r.name: (r.rows, r.distinct, round(r.null_pct)) for r in profile.columns(events, ["country", "bid_price"]).collect()}
    assert got == {"country": (10, 3, 20), "bid_price": (10, 2, 80)}
    assert profile.samples(events, "country") == ["JP", "NA", "US"]
    counts = {(r.grouping, r.key): r.n for r in profile.distribution(events, M).collect()}
    assert counts["type", "serve"] == 3 and counts["advertiser_id|type", "1|impression"] == 2 and ("advertiser_id|type", "|click") not in counts
    s = profile.summary(events, M)
    assert s["rows"] == 10 and s["top_countries"][0] == ("US", 5) and s["first_day"] == "2024-01-01"
    specs = [parse({"select": ["type", {"COUNT": "*"}], "group_by": ["type"], "where": [{"col": "country", "op": "eq", "val": "US"}]}, M)] * 3
    w = profile.workload(specs, M)
    assert w.where["country"] == 3 and w.patterns[("type",)] == 3
    assert profile.selectivity(specs[0], {"country": 4}) == 0.25 and profile.scan_estimates(specs, 100, {"country": 4, "type": 4})[0] == (25, 4)
    assert any("country" in line for line in profile.advice(w, {"country": (3, 20.0), "bid_price": (2, 80.0)}, M))


def test_empty_events(spark):
    e = Engine.frames(spark, spark.createDataFrame([], M.schema), rollup_names=None)
    for query, r in itertools.product(({"select": [{"SUM": "bid_price"}, {"COUNT": "*"}]},), ("detail", "rollup")):
        assert rows(e.query(query, r)) == [(None, 0)]
    assert e.query({"select": ["day", {"COUNT": "*"}], "group_by": ["day"]}, "day_type").count() == 0
