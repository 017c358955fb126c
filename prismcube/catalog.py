"""Registered queries of the cube engine, each with the DuckDB SQL that must give the same rows.

The driver's ``events`` table has another shape than advertising events; AD_VIEW maps it, so that every kind of value
occurs: sparse measures, groups without any value, a null country. Sums and averages are rounded to six places on both
sides, since the order of additions differs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcube.engine import Engine
from prismcube.functions.timedims import SQL_TIME_DIM, TimeEncoding, time_dim
from prismcube.model import AD_EVENTS, ORDER_LINES, CubeModel
from prismcube.operators import profile, rollups
from prismcube.operators.compile import quoted, with_coarser, with_time_dims
from prismcube.plans.spec import Aggregate, parse, to_sql

MODEL = CubeModel(AD_EVENTS.table, "ts", False, AD_EVENTS.schema, AD_EVENTS.measures, AD_EVENTS.rollups, AD_EVENTS.detail_order)
COUNTRIES = ("US", "JP", "GB", "DE", "FR", "CA", "CN", "KR", "ES", "IT", "BR")

AD_VIEW = f"""(select ts,
  case event_type when 'view' then 'impression' when 'signup' then 'serve' when 'error' then 'serve' else event_type end as type,
  cast(event_id as varchar) as auction_id, cast(user_id as int) as advertiser_id, user_id,
  cast(regexp_extract(props, '([0-9]+)', 1) as int) as publisher_id,
  case when event_type = 'view' then value end as bid_price,
  case when event_type = 'purchase' then value end as total_price,
  case cast(user_id % 12 as int) {' '.join(f"when {i} then '{c}'" for i, c in enumerate(COUNTRIES))} end as country
from events) as ad"""


def ad_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    country = F.lit(None).cast("string")
    for i, c in enumerate(COUNTRIES):
        country = F.when(F.col("user_id") % 12 == i, c).otherwise(country)
    return e.select(
        "ts",
        F.when(kind == "view", "impression").when(kind.isin("signup", "error"), "serve").otherwise(kind).alias("type"),
        F.col("event_id").cast("string").alias("auction_id"),
        F.col("user_id").cast("int").alias("advertiser_id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("publisher_id"),
        F.when(kind == "view", F.col("value")).alias("bid_price"),
        "user_id",
        F.when(kind == "purchase", F.col("value")).alias("total_price"),
        country.alias("country"),
    )


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(quoted(n), 6).alias(n) if kind == "double" else quoted(n) for n, kind in df.dtypes))


def _eq(column, value):
    return {"col": column, "op": "eq", "val": value}


def q(select: list, where: list | None = None, group_by: list | None = None, order_by: list | None = None, limit: int | None = None) -> dict:
    parts = {"select": select, "from": "events", "where": where, "group_by": group_by, "order_by": order_by, "limit": limit}
    return {k: v for k, v in parts.items() if v is not None}


SUM, COUNT, IMPRESSION, PURCHASE = {"SUM": "bid_price"}, {"COUNT": "*"}, _eq("type", "impression"), _eq("type", "purchase")
DAYS = {"col": "day", "op": "between", "val": ["2024-01-10", "2024-01-13"]}
BY_COUNT = [{"col": "COUNT(*)", "dir": "desc"}]

#: Query documents by name; each runs over detail rows and by its route (see QUERIES).
DOCUMENTS: dict[str, dict] = {
    "daily_revenue": q(["day", SUM], [IMPRESSION], ["day"]),
    "publisher_country_range": q(["publisher_id", SUM], [IMPRESSION, _eq("country", "JP"), DAYS], ["publisher_id"]),
    "avg_purchase_country": q(["country", {"AVG": "total_price"}], [PURCHASE], ["country"], [{"col": "AVG(total_price)", "dir": "desc"}]),
    "advertiser_type_counts": q(["advertiser_id", "type", COUNT], None, ["advertiser_id", "type"], BY_COUNT),
    "minutely_spend": q(["minute", SUM], [IMPRESSION, _eq("day", "2024-01-15")], ["minute"], [{"col": "minute", "dir": "asc"}]),
    "day_type_in": q(["day", "type", COUNT], [{"col": "type", "op": "in", "val": ["click", "purchase"]}], ["day", "type"]),
    "week_country_sum": q(["week", "country", SUM], [IMPRESSION], ["week", "country"]),
    "hour_publisher_avg": q(["hour", "publisher_id", {"AVG": "bid_price"}], [IMPRESSION, _eq("country", "US")], ["hour", "publisher_id"]),
    "day_range_multi": q(["day", SUM, {"SUM": "total_price"}, COUNT], [DAYS], ["day"]),
    "country_advertiser_multi": q(["country", "advertiser_id", COUNT, {"MAX": "bid_price"}], [IMPRESSION, {"col": "day", "op": "gte", "val": "2024-01-20"}], ["country", "advertiser_id"]),
    "us_daily": q(["day", COUNT], [IMPRESSION, _eq("country", "US")], ["day"], [{"col": "day", "dir": "asc"}]),
    "hourly_avg": q(["hour", {"AVG": "bid_price"}], [IMPRESSION], ["hour"]),
    "advertiser_purchases": q(["advertiser_id", {"SUM": "total_price"}, COUNT], [PURCHASE], ["advertiser_id"]),
    "country_in_counts": q(["country", COUNT], [{"col": "country", "op": "in", "val": ["JP", "KR", "CN"]}], ["country"]),
    "publisher_neq": q(["publisher_id", COUNT], [{"col": "type", "op": "neq", "val": "serve"}], ["publisher_id"]),
    "day_advertiser_range": q(["advertiser_id", SUM], [IMPRESSION, {"col": "day", "op": "between", "val": ["2024-01-08", "2024-01-14"]}], ["advertiser_id"]),
    "hour_country_in": q(["hour", "country", COUNT], [{"col": "country", "op": "in", "val": ["DE", "FR", "ES"]}], ["hour", "country"]),
    "bid_stats": q(["type", {"MIN": "bid_price"}, {"MAX": "bid_price"}, {"AVG": "bid_price"}, {"COUNT": "bid_price"}], None, ["type"]),
    "christmas_minutes": q(["minute", COUNT], [_eq("day", "2024-01-25"), IMPRESSION], ["minute"]),
    "country_day_type": q(["day", "type", COUNT, SUM], [_eq("country", "CA"), {"col": "day", "op": "lte", "val": "2024-01-31"}], ["day", "type"]),
    "week_country_topk": q(["week", "country", SUM], [IMPRESSION], ["week", "country"], [{"col": "SUM(bid_price)", "dir": "desc"}, {"col": "week"}, {"col": "country"}], 20),
    "f_eq": q([COUNT], [_eq("country", "US")]),
    "f_neq": q([COUNT], [{"col": "country", "op": "ne", "val": "US"}]),
    "f_gt": q([COUNT], [{"col": "bid_price", "op": "gt", "val": 50}]),
    "f_gte": q([COUNT], [{"col": "day", "op": "gte", "val": "2024-01-20"}]),
    "f_lt": q([COUNT], [{"col": "hour", "op": "lt", "val": "2024-01-20 12:00"}]),
    "f_lte": q([COUNT], [{"col": "advertiser_id", "op": "lte", "val": "50"}]),
    "f_in": q([COUNT], [{"col": "week", "op": "in", "val": ["2024-W01", "2024-W03"]}]),
    "f_between": q([COUNT], [{"col": "minute", "op": "between", "val": ["2024-01-05 10:00", "2024-01-06 09:59"]}]),
    "f_is_null": q([COUNT], [_eq("country", None)]),
    "f_is_not_null": q([COUNT], [{"col": "bid_price", "op": "neq", "val": None}]),
    "f_conj": q([COUNT], [IMPRESSION, _eq("country", "JP"), {"col": "bid_price", "op": "lt", "val": 100.5}]),
    "f_none": q([COUNT]),
    "p_raw": q(["auction_id", "type", "country", "bid_price"], [_eq("day", "2024-01-03")]),
    "p_distinct_dims": q(["country", "type"], None, ["country", "type"]),
    "p_select_order": q([COUNT, "type", SUM, "day"], None, ["day", "type"]),
    "a_sum": q(["type", SUM], None, ["type"]),
    "a_avg": q(["type", {"AVG": "total_price"}], None, ["type"]),
    "a_count_star": q(["country", COUNT], None, ["country"]),
    "a_count_col": q(["country", {"COUNT": "total_price"}], None, ["country"]),
    "a_min": q(["country", {"MIN": "bid_price"}], None, ["country"]),
    "a_max": q(["country", {"MAX": "total_price"}], None, ["country"]),
    "a_multi": q(["day", {"SUM": "bid_price", "AVG": "bid_price", "MIN": "bid_price"}, {"max": "bid_price", "count": "*"}], None, ["day"]),
    "a_global": q([SUM, {"AVG": "total_price"}, COUNT, {"MIN": "bid_price"}, {"MAX": "bid_price"}]),
    "a_global_empty": q([SUM, COUNT, {"COUNT": "bid_price"}], [_eq("country", "ZZ")]),
    "a_all_null_group": q(["type", SUM, {"AVG": "bid_price"}, {"COUNT": "bid_price"}], [_eq("type", "click")], ["type"]),
    "a_null_key": q(["country", SUM, COUNT], [_eq("country", None)], ["country"]),
    "a_count_distinct": q(["type", {"COUNT_DISTINCT": "country"}], None, ["type"]),
    "a_stddev": q(["type", {"STDDEV": "bid_price"}], None, ["type"]),
    "a_median": q(["country", {"MEDIAN": "bid_price"}], None, ["country"]),
    "t_day": q(["day", COUNT], None, ["day"]),
    "t_hour": q(["hour", COUNT], None, ["hour"]),
    "t_minute": q(["minute", COUNT], None, ["minute"]),
    "t_week": q(["week", COUNT], None, ["week"]),
    "o_multi_key": q(["country", "type", COUNT], None, ["country", "type"], [{"col": "country", "dir": "desc"}, {"col": "type"}]),
    "o_by_aggregate": q(["country", COUNT], None, ["country"], [{"col": "SUM(total_price)", "dir": "desc"}]),
    "o_topk": q(["advertiser_id", SUM], [IMPRESSION], ["advertiser_id"], [{"col": "SUM(bid_price)", "dir": "desc"}, {"col": "advertiser_id"}], 10),
    "rw_reaggregate": q(["country", SUM, {"AVG": "bid_price"}], [IMPRESSION], ["country"]),
    "rw_derive_day": q(["day", "country", COUNT, SUM], None, ["day", "country"]),
    "rw_derive_hour": q(["hour", SUM], [IMPRESSION], ["hour"]),
    "rw_derive_week": q(["week", "country", SUM, {"MIN": "bid_price"}], None, ["week", "country"]),
    "rw_global": q([SUM, {"AVG": "bid_price"}, COUNT]),
    "rw_global_empty": q([SUM, COUNT, {"COUNT": "total_price"}], [_eq("country", "ZZ")]),
    "rw_count_dim": q(["type", {"COUNT": "country"}, {"MIN": "country"}, {"MAX": "day"}], None, ["type"]),
    "rw_fallback": q(["country", {"COUNT": "user_id"}], None, ["country"]),
}
#: Queries that are answered from a rollup here (from its name on); all others from detail rows.
ON_ROLLUP = {
    "rw_reaggregate": "day_country_type", "rw_derive_day": "hour_country_type", "rw_derive_hour": "minute_type", "rw_derive_week": "day_country_type",
    "rw_global": "country_type", "rw_global_empty": "country_type", "rw_count_dim": "day_country_type", "publisher_country_range": "day_publisher_country_type",
    "bid_stats": "country_type", "minutely_spend": "minute_type",
}

#: Over order lines, to show that the engine knows nothing of advertising.
LINE_DOCUMENTS: dict[str, dict] = {
    "li_flag_status": {"select": ["l_returnflag", "l_linestatus", {"SUM": "l_quantity", "AVG": "l_extendedprice"}, {"COUNT": "*"}], "group_by": ["l_returnflag", "l_linestatus"]},
    "li_week": {"select": ["week", {"SUM": "l_extendedprice"}], "where": [{"col": "l_returnflag", "op": "eq", "val": "R"}], "group_by": ["week"]},
    "li_supplier_topk": {"select": ["l_suppkey", {"SUM": "l_extendedprice"}], "group_by": ["l_suppkey"], "order_by": [{"col": "SUM(l_extendedprice)", "dir": "desc"}, {"col": "l_suppkey"}], "limit": 15},
}


def answer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    route = ON_ROLLUP.get(name)
    engine = Engine.frames(spark, ad_events(spark, sf_dir), MODEL, (route,) if route else ())
    return rounded(engine.query(DOCUMENTS[name], route or "detail"))


def line_answer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(Engine.frames(spark, lines, ORDER_LINES).query(LINE_DOCUMENTS[name]))


def whole_rollup(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return rounded(rollups.build(ad_events(spark, sf_dir), MODEL.rollup(name), MODEL))


def lattice_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day_type, derived from the finer rollups instead of built from rows."""
    return rounded(rollups.build_lattice(ad_events(spark, sf_dir), MODEL.rollups, MODEL)["day_type"])


def grouping_set_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """country_type out of the one pass that builds all rollups."""
    return rounded(rollups.build_by_grouping_sets(ad_events(spark, sf_dir), MODEL.rollups, MODEL)["country_type"])


def merged_rollup(spark: SparkSession, sf_dir: str, join: bool = False) -> DataFrame:
    """day_country_type merged from the rollups of two halves of the events."""
    events, definition = ad_events(spark, sf_dir), MODEL.rollup("day_country_type")
    parts = [rollups.build(events.where(F.col("advertiser_id") % 2 == i), definition, MODEL) for i in (0, 1)]
    return rounded(rollups.merge_by_join(*parts, definition, MODEL) if join else rollups.merge(parts, definition, MODEL))


def week_monday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks by their Monday."""
    return ad_events(spark, sf_dir).groupBy(time_dim("week", F.col("ts"), TimeEncoding.TRUNC).alias("week")).agg(F.count(F.lit(1)).alias("COUNT(*)"))


def one_day_of_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of the minute rollup."""
    definition = MODEL.rollup("minute_type")
    frame = rollups.build(ad_events(spark, sf_dir), definition, MODEL)
    return rounded(with_coarser(frame, definition, {"day"}, MODEL).where(F.col("day") == "2024-01-15"))


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = with_time_dims(ad_events(spark, sf_dir), MODEL)
    return rounded(profile.columns(events, ["type", "country", "advertiser_id", "publisher_id", "day", "bid_price", "total_price"]))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distribution(ad_events(spark, sf_dir), MODEL)


def sql_of(document: dict, model: CubeModel, source: str) -> str:
    """A document's SQL with the rounding that the registered query has."""
    spec = parse(document, model)
    columns = [x if isinstance(x, str) else x.name for x in spec.select]
    real = lambda x: not isinstance(x, str) and (x.func in ("AVG", "STDDEV", "MEDIAN") or x.func in ("SUM", "MIN", "MAX") and model.columns.get(x.column, None).typeName() == "double")
    shown = [f'round("{n}", 6) as "{n}"' if real(x) or isinstance(x, str) and model.columns[x].typeName() == "double" else f'"{n}"' for n, x in zip(columns, spec.select)]
    return f"select {', '.join(shown)} from ({to_sql(spec, model, source)}) as answer"


def state_sql(dims: tuple[str, ...], where: str = "") -> str:
    parts = [f"{SQL_TIME_DIM.get(d, d)} as {d}" for d in dims]
    for m in MODEL.measures:
        parts += [f"round(sum({m}), 6) as {m}_sum", f"count({m}) as {m}_count", f"round(min({m}), 6) as {m}_min", f"round(max({m}), 6) as {m}_max"]
    return f"select {', '.join(parts)}, count(*) as row_count from {AD_VIEW} {where} group by {', '.join(SQL_TIME_DIM.get(d, d) for d in dims)}"


def cardinality_sql() -> str:
    names = {"type": "type", "country": "country", "advertiser_id": "advertiser_id", "publisher_id": "publisher_id", "day": SQL_TIME_DIM["day"], "bid_price": "bid_price", "total_price": "total_price"}
    return " union all ".join(f"select '{n}' as name, count(*) as rows, count(distinct {c}) as \"distinct\", round(100 * (count(*) - count({c})) / count(*), 6) as null_pct from {AD_VIEW}" for n, c in names.items())


def distribution_sql() -> str:
    out = []
    for g in profile.DISTRIBUTION:
        exprs = [SQL_TIME_DIM.get(d, d) for d in g]
        key = " || '|' || ".join(f"coalesce(cast({e} as varchar), '')" for e in exprs)
        ids = " and ".join(f"{d} is not null" for d in g if d.endswith("_id"))
        out.append(f"select '{'|'.join(g)}' as grouping, {key} as key, count(*) as n from {AD_VIEW} {'where ' + ids if ids else ''} group by {', '.join(exprs)}")
    return " union all ".join(out).replace("as grouping", 'as "grouping"')


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{n: partial(answer, name=n) for n in DOCUMENTS},
    **{n: partial(line_answer, name=n) for n in LINE_DOCUMENTS},
    **{f"r_{r.name}": partial(whole_rollup, name=r.name) for r in MODEL.rollups},
    "t_week_trunc": week_monday,
    "m_merge_partials": merged_rollup,
    "m_merge_join": partial(merged_rollup, join=True),
    "m_lattice_equals_direct": lattice_rollup,
    "m_grouping_sets": grouping_set_rollup,
    "m_minutes_of_day": one_day_of_minutes,
    "n_cardinality": cardinality,
    "n_distribution": distribution,
}

SQL: dict[str, str] = {
    **{n: sql_of(d, MODEL, AD_VIEW) for n, d in DOCUMENTS.items()},
    **{n: sql_of(d, ORDER_LINES, "lineitem") for n, d in LINE_DOCUMENTS.items()},
    **{f"r_{r.name}": state_sql(r.dims) for r in MODEL.rollups},
    "t_week_trunc": f"select strftime(date_trunc('week', ts), '%Y-%m-%d') as week, count(*) as \"COUNT(*)\" from {AD_VIEW} group by 1",
    "m_merge_partials": state_sql(("day", "country", "type")),
    "m_merge_join": state_sql(("day", "country", "type")),
    "m_lattice_equals_direct": state_sql(("day", "type")),
    "m_grouping_sets": state_sql(("country", "type")),
    "m_minutes_of_day": state_sql(("day", "minute", "type"), "where strftime(ts, '%Y-%m-%d') = '2024-01-15'"),
    "n_cardinality": cardinality_sql(),
    "n_distribution": distribution_sql(),
}
