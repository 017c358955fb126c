"""Registered queries that go the way a user goes: CSV parts, prepare, a stored warehouse, automatic routes.

One warehouse is built for each table of events and session, below the shared folder. Its events are those of
``catalog.ad_events``, written as CSV with times in epoch milliseconds. The SQL reads the driver's own tables.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcube import catalog, sinks
from prismcube.engine import Engine
from prismcube.errors import QueryError
from prismcube.functions.timedims import SQL_TIME_DIM, calendar_day, day_of_year, sunday_week
from prismcube.model import AD_EVENTS, COMBINED, CORE, CubeModel
from prismcube.operators import profile
from prismcube.operators.compile import quoted, with_time_dims
from prismcube.plans.spec import parse
from prismcube.scratch import shared_folder
from prismcube.sources import events as sources
from prismcube.sources import queries as documents
from prismcube.streaming.incremental import keep_current

#: The query corpus: documents over the whole table, of every shape.
CORPUS = [n for n in catalog.DOCUMENTS if not n.startswith(("f_", "p_", "a_", "t_", "o_", "rw_"))]
DAY = "2024-01-15"

_HOUSES: dict[tuple, Engine] = {}


def folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/prismcube-{what}-{uuid.uuid4().hex}"


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the shipped model has them: times in epoch milliseconds."""
    rows = catalog.ad_events(spark, sf_dir)
    return rows.withColumn("ts", F.unix_millis(F.col("ts").cast("timestamp"))).select(*AD_EVENTS.schema.names)


def csv_parts(spark: SparkSession, sf_dir: str) -> str:
    where = folder(spark, "csv")
    raw_events(spark, sf_dir).repartition(3).write.option("header", True).csv(where)
    return where


def written(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: other ones are another table, though its path is the same."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    each = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in each))


def house(spark: SparkSession, sf_dir: str) -> Engine:
    """CSV parts, read with types and prepared with all rollups, the minute rollup by day; anew when the events changed."""
    key = spark.sparkContext.applicationId, sf_dir, written(spark, f"{sf_dir}/events.parquet")
    if key not in _HOUSES:
        engine = Engine(spark, AD_EVENTS, folder(spark, "house"))
        engine.prepare(sources.read_csv(spark, csv_parts(spark, sf_dir), AD_EVENTS))
        _HOUSES[key] = engine
    return _HOUSES[key]


def answer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return catalog.rounded(house(spark, sf_dir).query(catalog.DOCUMENTS[name]))


def totals(events: DataFrame) -> DataFrame:
    """Rows and sums by type, of events in any form."""
    return catalog.rounded(events.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("country").alias("countries"), F.sum("bid_price").alias("bids"), F.sum("total_price").alias("prices")))


TOTALS = f"select type, count(*) as n, count(country) as countries, round(sum(bid_price), 6) as bids, round(sum(total_price), 6) as prices from {catalog.AD_VIEW} group by type"


def csv_typed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return totals(sources.read_csv(spark, csv_parts(spark, sf_dir), AD_EVENTS, **how))


def csv_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose columns differ in order, one without the countries: matched by their headers."""
    events, where, names = raw_events(spark, sf_dir), folder(spark, "csv"), AD_EVENTS.schema.names
    events.where("user_id % 2 = 0").write.option("header", True).csv(where)
    events.where("user_id % 2 = 1").select(*(n for n in reversed(names) if n != "country")).write.mode("append").option("header", True).csv(where)
    return totals(sources.read_csv(spark, where, AD_EVENTS))


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "parquet")
    sources.convert(sources.read_csv(spark, csv_parts(spark, sf_dir), AD_EVENTS), where)
    return totals(sources.read_parquet(spark, where))


def detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return house(spark, sf_dir).warehouse.detail().groupBy("week", "country", "type").agg(F.count(F.lit(1)).alias("n"))


def as_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources.registered(raw_events(spark, sf_dir), "ad_events_view")
    return spark.sql("select type, count(*) as n, count(country) as countries, round(sum(bid_price), 6) as bids, round(sum(total_price), 6) as prices from ad_events_view group by type")


def query_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows of a query read from every kind of source: array, object, module, folder, text, none."""
    with tempfile.TemporaryDirectory() as home:
        some, doc = Path(home), catalog.DOCUMENTS["country_in_counts"]
        (some / "one").mkdir()
        (some / "array.json").write_text(json.dumps([doc]))
        (some / "object.json").write_text(json.dumps(doc))
        (some / "inputs.py").write_text(f"queries = [{doc!r}]\n")
        (some / "one" / "first.json").write_text(json.dumps(doc))
        found = {"array": documents.load(str(some / "array.json")), "object": documents.load(str(some / "object.json")), "module": documents.load(folder=home), "folder": documents.load(folder=str(some / "one")), "text": [("q1", q) for q in documents.from_text(json.dumps(doc))], "default": documents.load()}
    engine = house(spark, sf_dir)
    return spark.createDataFrame([(kind, name, engine.query(q).count()) for kind, some in found.items() for name, q in some], "source string, name string, n long")


def column_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a column: how many values it has, and whether all of them occur."""
    events = raw_events(spark, sf_dir)
    got = sources.column_sample(events, "publisher_id", 100)
    return got.join(F.broadcast(events.select("publisher_id").distinct().withColumn("known", F.lit(True))), "publisher_id", "left").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known"))


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, scaled up: is the count within a fifth of the truth?"""
    events = raw_events(spark, sf_dir)
    got, factor = sources.row_sample(events, 0.1, 7)
    return got.agg((F.count(F.lit(1)) * factor).alias("guess")).join(events.agg(F.count(F.lit(1)).alias("rows"))).select((F.abs(F.col("guess") / F.col("rows") - 1) < 0.2).alias("close"))


def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup written with every codec and read back."""
    events, out = raw_events(spark, sf_dir), []
    for codec in ("lz4", "zstd", "none"):
        engine = Engine(spark, AD_EVENTS, folder(spark, "codec"))
        engine.prepare(events, ["day_type"], compression=codec, detail=False)
        out.append(engine.warehouse.stored("day_type").withColumn("codec", F.lit(engine.warehouse.manifest.rollups["day_type"].compression)))
    return catalog.rounded(out[0].unionByName(out[1]).unionByName(out[2]))


def one_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition of the stored minute rollup."""
    return catalog.rounded(house(spark, sf_dir).warehouse.partition("minute_type", DAY))


def partition_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in house(spark, sf_dir).warehouse.partition_keys("minute_type")], "day string")


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's CSV file, as text."""
    with tempfile.TemporaryDirectory() as home:
        sinks.write_csv(house(spark, sf_dir).query(catalog.DOCUMENTS["o_multi_key"]), f"{home}/q1.csv")
        lines = Path(home, "q1.csv").read_text().splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus and a document that fails, as a batch: what became of each, and whether its files are there."""
    with tempfile.TemporaryDirectory() as home:
        done = house(spark, sf_dir).run_batch([*((n, catalog.DOCUMENTS[n]) for n in CORPUS), ("wrong", {"select": ["nothing"]})], home)
        timings = json.loads(Path(home, "timing_results.json").read_text())
        rows = [(o.name, o.table or "", -1 if o.rows is None else o.rows, o.error is None, Path(home, f"{o.name}.csv").exists(), t["name"] == o.name) for o, t in zip(done, timings, strict=True)]
    return spark.createDataFrame(rows, "name string, rollup string, rows long, ok boolean, file boolean, timed boolean")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = house(spark, sf_dir)
    found = [(n, engine.route(d)) for n, d in catalog.DOCUMENTS.items()]
    return spark.createDataFrame([(n, r.table, r.is_rollup, -1 if r.rows is None else r.rows) for n, r in found], "name string, rollup string, is_rollup boolean, rows long")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return house(spark, sf_dir).warehouse.info().select("name", "dims", "rows", "compression", "partitioned_by")


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared table's statistics: nulls, and whether the distinct counts are near the exact ones."""
    exact = profile.columns(with_time_dims(raw_events(spark, sf_dir), AD_EVENTS)).select("name", F.col("distinct").alias("exact"))
    return house(spark, sf_dir).warehouse.statistics().join(exact, "name").select("name", "nulls", (F.abs(F.col("distinct") - F.col("exact")) <= 2 + 0.15 * F.col("exact")).alias("close"))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(what, passed) for what, passed, _ in house(spark, sf_dir).validate()], "what string, passed boolean")


def preloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer from memory, and one after it was let go."""
    engine = Engine(spark, AD_EVENTS, house(spark, sf_dir).warehouse.path)
    n = engine.preload()
    rows = [("preloaded", n, r[0], r[1]) for r in engine.query(catalog.DOCUMENTS["a_count_star"]).collect()]
    engine.warehouse.reset()
    rows += [("reset", n, r[0], r[1]) for r in engine.query(catalog.DOCUMENTS["a_count_star"]).collect()]
    return spark.createDataFrame(rows, "state string, rollups long, country string, n long")


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the rollups of both presets, each prepared by itself and without partitions."""
    events, out = raw_events(spark, sf_dir), []
    for preset, names in (("core", CORE), ("combined", COMBINED)):
        engine = Engine(spark, AD_EVENTS, folder(spark, preset))
        out += [(preset, n, rows) for n, rows in engine.prepare(events, names, detail=False, partition_minutes=False).items()]
    return spark.createDataFrame(out, "preset string, name string, rows long")


def built(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """hour_type of a warehouse prepared by another method."""
    engine = Engine(spark, AD_EVENTS, folder(spark, method))
    engine.prepare(raw_events(spark, sf_dir), ["minute_type", "hour_type"], method, detail=False)
    return catalog.rounded(engine.rollup("hour_type"))


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day_country_type of events that came in four appends, one of which was given twice."""
    events, engine = raw_events(spark, sf_dir), Engine(spark, AD_EVENTS, folder(spark, "append"))
    part = lambda i: events.where(F.col("advertiser_id") % 4 == i)
    engine.prepare(part(0), ["day_country_type"])
    for i in (1, 2, 2, 3):
        engine.append(part(i), ("loader", i))
    return catalog.rounded(engine.rollup("day_country_type"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day_type and detail rows of events that came in as two streams of two files each, the first started twice."""
    events, home = raw_events(spark, sf_dir), folder(spark, "stream")
    engine = Engine(spark, AD_EVENTS, f"{home}/house")
    engine.prepare(events.limit(0), ["day_type"])
    for i in (0, 1):
        events.where(F.col("advertiser_id") % 2 == i).repartition(2).write.parquet(f"{home}/in{i}")
    for i in (0, 0, 1):
        stream = spark.readStream.schema(AD_EVENTS.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in{i}")
        keep_current(engine, stream, f"{home}/checkpoint{i}").awaitTermination()
    rows = engine.warehouse.detail().groupBy("day", "type").agg(F.count(F.lit(1)).alias("detail_rows"))
    return catalog.rounded(engine.rollup("day_type").join(rows, ["day", "type"]))


#: Documents that must be refused, and why.
WRONG: dict[str, dict] = {
    "operator": {"select": ["type"], "where": [{"col": "type", "op": "like", "val": "a"}]},
    "function": {"select": [{"PRODUCT": "bid_price"}]},
    "column": {"select": ["nothing"]},
    "no select": {"from": "events"},
    "table": {"select": ["type"], "from": "others"},
    "between": {"select": ["type"], "where": [{"col": "day", "op": "between", "val": ["2024-01-01"]}]},
    "number": {"select": ["type"], "where": [{"col": "bid_price", "op": "gt", "val": "much"}]},
    "not grouped": {"select": ["type", {"COUNT": "*"}]},
    "direction": {"select": ["type"], "order_by": [{"col": "type", "dir": "up"}]},
    "part": {"select": ["type"], "having": []},
}


def refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    def wrong(document: dict) -> bool:
        try:
            house(spark, sf_dir).query(document)
        except QueryError:
            return True
        return False

    return spark.createDataFrame([(n, wrong(d)) for n, d in WRONG.items()], "what string, refused boolean")


def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows, in order of their ids."""
    return raw_events(spark, sf_dir).select("auction_id", "type").orderBy(F.col("auction_id").cast("long")).limit(10)


def other_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of the year, back to calendar days, and weeks that start on Sunday."""
    rows = with_time_dims(raw_events(spark, sf_dir), AD_EVENTS).withColumn("t", F.timestamp_millis("ts"))
    rows = rows.select(day_of_year(F.col("t")).alias("day_of_year"), sunday_week(F.col("t")).alias("sunday_week"))
    return rows.select(calendar_day(F.col("day_of_year")).alias("day"), "day_of_year", "sunday_week").groupBy("day", "day_of_year", "sunday_week").agg(F.count(F.lit(1)).alias("n"))


def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = raw_events(spark, sf_dir)
    return events.agg(*(F.sum(quoted(c).isNull().cast("int")).alias(c) for c in ("bid_price", "total_price", "country", "type")))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the events in another zone, which has no summer time."""
    t = F.from_utc_timestamp(F.timestamp_millis("ts"), "Asia/Tokyo")
    return raw_events(spark, sf_dir).groupBy(F.date_format(t, "yyyy-MM-dd HH:00").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the corpus reads what."""
    w = profile.workload([catalog.DOCUMENTS[n] for n in CORPUS], AD_EVENTS)
    parts = {"where": w.where, "op": w.ops, "group": w.group, "select": w.selected, "aggregate": w.aggregates, "order": w.order}
    return spark.createDataFrame([(k, item, n) for k, c in parts.items() for item, n in c.items()], "part string, item string, n long")


def documents_sql(names: Iterable[str]) -> str:
    return "(values " + ", ".join("('" + json.dumps(catalog.DOCUMENTS[n]).replace("'", "''") + "'::json)" for n in names) + ") as d(doc)"


def workload_sql() -> str:
    each, docs = "json_extract(doc, '$.{}[*]')", documents_sql(CORPUS)
    unnested = lambda part: f"(select row_number() over () as q, unnest({each.format(part)}) as x from (select doc from {docs}))"
    listed = lambda part: f"(select q, unnest(json_extract(doc, '$.{part}[*]')) as x from (select row_number() over () as q, doc from {docs}))"
    agg = f"(select k || '(' || json_extract_string(x, '$.' || k) || ')' as item from (select x, unnest(json_keys(x)) as k from {unnested('select')} where json_type(x) = 'OBJECT'))"
    return f"""select 'where' as part, item, count(*) as n from (select distinct q, json_extract_string(x, '$.col') as item from {listed('where')}) group by item
  union all select 'op', json_extract_string(x, '$.op'), count(*) from {listed('where')} group by all
  union all select 'group', json_extract_string(x, '$'), count(*) from {listed('group_by')} group by all
  union all select 'select', json_extract_string(x, '$'), count(*) from {listed('select')} where json_type(x) = 'VARCHAR' group by all
  union all select 'aggregate', item, count(*) from {agg} group by all
  union all select 'order', json_extract_string(x, '$.col'), count(*) from {listed('order_by')} group by all"""


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected selectivity and scan of some queries, from the exact distinct counts."""
    events = with_time_dims(raw_events(spark, sf_dir), AD_EVENTS)
    distinct = {r.name: (r.distinct, r.rows) for r in profile.columns(events, ["type", "country", "day"]).collect()}
    total, specs = distinct["type"][1], {n: parse(catalog.DOCUMENTS[n], AD_EVENTS) for n in ESTIMATED}
    known = {k: v[0] for k, v in distinct.items()}
    found = profile.scan_estimates(specs.values(), total, known)
    return spark.createDataFrame([(n, round(profile.selectivity(s, known), 9), *e) for (n, s), e in zip(specs.items(), found)], "name string, selectivity double, read long, groups long")


#: Documents and, as SQL over the counts t, c, d (types, countries, days), the share of rows and the groups that they should have.
ESTIMATED = {
    "daily_revenue": ("1.0 / t", "d"),
    "us_daily": ("1.0 / t / c", "d"),
    "country_in_counts": ("3.0 / c", "c"),
    "day_range_multi": ("5.0 / 366", "d"),
    "f_neq": ("1 - 1.0 / c", "1"),
    "f_none": ("1.0", "1"),
}


def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for a small workload: three queries of five filter on the day, two on the country, one needs a new rollup."""
    where = lambda *columns: {"select": [{"COUNT": "*"}], "where": [catalog._eq(c, "1") for c in columns]}
    w = profile.workload([where("day"), where("day", "country"), where("day", "country"), where(), where("advertiser_id", "publisher_id")], AD_EVENTS)
    each = {r.name: (r.distinct, r.null_pct or 0.0) for r in profile.columns(raw_events(spark, sf_dir), ["country", "total_price"]).collect()}
    lines = profile.advice(w, each, AD_EVENTS)
    has = lambda *words: any(all(x in line for x in words) for line in lines)
    found = {"partition by day": has("partition", "day"), "order by country": has("order", "country"), "few countries": has("country has"), "sparse prices": has("total_price", "null"), "new rollup": has("add a rollup", "advertiser_id", "publisher_id")}
    return spark.createDataFrame(list(found.items()), "what string, said boolean")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.summary(raw_events(spark, sf_dir), AD_EVENTS)
    return spark.createDataFrame([(s["rows"], s["first_day"], s["last_day"], round(s["rows_a_day"], 6), n, c, k) for n, (c, k) in enumerate(s["top_countries"], 1)], "rows long, first_day string, last_day string, rows_a_day double, place long, country string, n long")


def loader_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and exact distinct counts of what CSV parts hold, and some values in order."""
    events = with_time_dims(sources.read_csv(spark, csv_parts(spark, sf_dir), AD_EVENTS), AD_EVENTS)
    some = profile.samples(events, "country", 5)
    return profile.columns(events, ["type", "country", "advertiser_id", "publisher_id", "day"]).select("name", "rows", "distinct").withColumn("sample", F.when(F.col("name") == "country", F.lit("|".join(some))))


def bool_sql(names: Iterable[str], first: str, second: str) -> str:
    return " union all ".join(f"select '{n}' as {first}, true as {second}" for n in names)


def rollup_rows_sql(dims: Iterable[str]) -> str:
    exprs = ", ".join(SQL_TIME_DIM.get(d, d) for d in dims)
    return f"(select count(*) from (select {exprs} from {catalog.AD_VIEW} group by {exprs}))"


#: Columns that each rollup can answer, written out; the minute rollup is kept by day.
COVERS = {
    "day_type": "day week type", "hour_type": "hour day week type", "minute_type": "minute hour day week type", "week_type": "week type", "country_type": "country type", "advertiser_type": "advertiser_id type",
    "publisher_type": "publisher_id type", "day_country_type": "day week country type", "day_advertiser_type": "day week advertiser_id type", "hour_country_type": "hour day week country type",
    "day_publisher_country_type": "day week publisher_id country type",
}
#: What the documents read beside measures, where an aggregate is over a dimension, and those that only rows can answer.
READ_BY_AGGREGATES = {"rw_count_dim": "country day"}
ROWS_ONLY = {"p_raw", "a_count_distinct", "a_stddev", "a_median", "rw_fallback"}


def routes_sql(names: Iterable[str]) -> str:
    """The covering rollup with the fewest groups, as DuckDB counts them."""
    sizes = " union all ".join(f"select '{r.name}' as rollup, {rollup_rows_sql(r.dims)} as rows" for r in AD_EVENTS.rollups)
    able = []
    for n in names:
        d = catalog.DOCUMENTS[n]
        reads = {*d.get("group_by", ()), *(w["col"] for w in d.get("where", ())), *READ_BY_AGGREGATES.get(n, "").split()}
        able += [(n, r) for r, have in COVERS.items() if n not in ROWS_ONLY and reads <= {*have.split()}]
    pairs = ", ".join(f"('{n}', '{r}')" for n, r in able)
    every = ", ".join(f"('{n}')" for n in names)
    return f"""select n.name, coalesce(best.rollup, 'detail') as rollup, best.rollup is not null as is_rollup, coalesce(best.rows, -1) as rows
  from (values {every}) as n(name) left join (
    select name, rollup, rows from (select a.name, s.rollup, s.rows, row_number() over (partition by a.name order by s.rows, s.rollup) as place
      from (values {pairs}) as a(name, rollup) join ({sizes}) as s using (rollup)) where place = 1) as best using (name)"""


def batch_sql() -> str:
    counts = " union all ".join(f"select '{n}' as name, (select count(*) from ({catalog.sql_of(catalog.DOCUMENTS[n], catalog.MODEL, catalog.AD_VIEW)})) as rows" for n in CORPUS)
    return f"""select r.name, r.rollup, c.rows, true as ok, true as file, true as timed from ({routes_sql(CORPUS)}) as r join ({counts}) as c using (name)
  union all select 'wrong', '', -1, false, false, true"""


def info_sql() -> str:
    row = "select '{}' as name, '{}' as dims, {} as rows, '{}' as compression, '{}' as partitioned_by"
    kept = lambda r: ("day", *r.dims) if r.name == "minute_type" else r.dims
    rows = [row.format(r.name, ",".join(kept(r)), rollup_rows_sql(r.dims), "zstd", "day" if r.name == "minute_type" else "") for r in AD_EVENTS.rollups]
    return " union all ".join([*rows, row.format("detail", "", "(select count(*) from events)", "snappy", "")])


def model_sql(document: dict, model: CubeModel) -> str:
    """The SQL that the engine itself gives for the shipped model, over a view with times in epoch milliseconds."""
    view = catalog.AD_VIEW.replace("select ts,", "select epoch_ms(ts) as ts,", 1)
    return catalog.sql_of(document, model, view)


def counted(group: str) -> str:
    return f"select {group}, count(*) as n from {catalog.AD_VIEW} group by all"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"w_{n}": partial(answer, name=n) for n in CORPUS},
    "s_csv_typed": csv_typed,
    "s_csv_strict": partial(csv_typed, strict=True),
    "s_csv_inferred": partial(csv_typed, infer=True),
    "s_csv_by_name": csv_by_name,
    "s_detail": detail_counts,
    "s_view": as_view,
    "s_query_sources": query_sources,
    "s_column_sample": column_sample,
    "s_row_sample": row_sample,
    "s_head": head,
    "k_codecs": codecs,
    "k_one_day": one_day,
    "k_partition_keys": partition_keys,
    "k_convert": converted,
    "k_result_file": result_files,
    "k_batch": batch,
    "k_info": info,
    "k_statistics": statistics,
    "v_refused": refused,
    "v_validate": validation,
    "r_routes": routes,
    "r_preload": preloaded,
    "m_presets": presets,
    "m_direct_warehouse": partial(built, method="direct"),
    "m_grouping_sets_warehouse": partial(built, method="grouping_sets"),
    "m_append": appended,
    "m_stream": streamed,
    "x_other_times": other_times,
    "x_null_counts": null_counts,
    "x_zone": zones,
    "n_workload": workload,
    "n_estimates": estimates,
    "n_advice": advice,
    "n_summary": overview,
    "n_loader_stats": loader_stats,
}

SQL: dict[str, str] = {
    **{f"w_{n}": model_sql(catalog.DOCUMENTS[n], AD_EVENTS) for n in CORPUS},
    **dict.fromkeys(("s_csv_typed", "s_csv_strict", "s_csv_inferred", "s_view", "k_convert"), TOTALS),
    "s_csv_by_name": TOTALS.replace("count(country)", "count(country) filter (user_id % 2 = 0)"),
    "s_detail": counted(f"{SQL_TIME_DIM['week']} as week, country, type"),
    "s_query_sources": " union all ".join(f"select '{k}' as source, '{n}' as name, (select count(*) from ({catalog.sql_of(catalog.DOCUMENTS['daily_revenue' if k == 'default' else 'country_in_counts'], catalog.MODEL, catalog.AD_VIEW)})) as n" for k, n in (("array", "q1"), ("object", "q1"), ("module", "q1"), ("folder", "first"), ("text", "q1"), ("default", "q1"))),
    "s_column_sample": "select cast(100 as bigint) as n, true as known",
    "s_row_sample": "select true as close",
    "s_head": f"select auction_id, type from {catalog.AD_VIEW} order by cast(auction_id as bigint) limit 10",
    "k_codecs": " union all ".join(f"select *, '{c}' as codec from ({catalog.state_sql(('day', 'type'))})" for c in ("lz4", "zstd", "none")),
    "k_one_day": catalog.state_sql(("day", "minute", "type"), f"where strftime(ts, '%Y-%m-%d') = '{DAY}'"),
    "k_partition_keys": f"select distinct {SQL_TIME_DIM['day']} as day from {catalog.AD_VIEW}",
    "k_result_file": f"select cast(0 as bigint) as line, 'country,type,COUNT(*)' as text union all select row_number() over (order by country desc nulls last, type), coalesce(country, '') || ',' || type || ',' || n from (select country, type, count(*) as n from {catalog.AD_VIEW} group by all)",
    "k_batch": batch_sql(),
    "k_info": info_sql(),
    "k_statistics": " union all ".join(f"select '{c}' as name, (select count(*) - count({SQL_TIME_DIM.get(c, c)}) from {catalog.AD_VIEW}) as nulls, true as close" for c in (*AD_EVENTS.schema.names, *SQL_TIME_DIM)),
    "v_refused": bool_sql(WRONG, "what", "refused"),
    "v_validate": bool_sql(("rollups", *sorted(r.name for r in AD_EVENTS.rollups), "detail", "smoke query"), "what", "passed"),
    "r_routes": routes_sql(catalog.DOCUMENTS),
    "r_preload": " union all ".join(f"select '{s}' as state, cast({len(AD_EVENTS.rollups)} as bigint) as rollups, country, n from ({counted('country')})" for s in ("preloaded", "reset")),
    "m_presets": " union all ".join(f"select '{p}' as preset, '{n}' as name, {rollup_rows_sql(AD_EVENTS.rollup(n).dims)} as rows" for p, names in (("core", CORE), ("combined", COMBINED)) for n in names),
    **dict.fromkeys(("m_direct_warehouse", "m_grouping_sets_warehouse"), catalog.state_sql(("hour", "type"))),
    "m_append": catalog.state_sql(("day", "country", "type")),
    "m_stream": f"select *, row_count as detail_rows from ({catalog.state_sql(('day', 'type'))})",
    "x_other_times": counted("strftime(ts, '%Y-%m-%d') as day, strftime(ts, '%Y-%j') as day_of_year, strftime(ts, '%Y-%U') as sunday_week"),
    "x_null_counts": f"select count(*) - count(bid_price) as bid_price, count(*) - count(total_price) as total_price, count(*) - count(country) as country, count(*) - count(type) as type from {catalog.AD_VIEW}",
    "x_zone": counted("strftime(ts + interval 9 hour, '%Y-%m-%d %H:00') as hour"),
    "n_workload": workload_sql(),
    "n_estimates": f"with k as (select count(distinct type) as t, count(distinct country) as c, count(distinct {SQL_TIME_DIM['day']}) as d, count(*) as total from {catalog.AD_VIEW}) "
    + " union all ".join(f"select '{n}' as name, round({s}, 9) as selectivity, cast(round(total * ({s})) as bigint) as read, least({g}, cast(round(total * ({s})) as bigint)) as groups from k" for n, (s, g) in ESTIMATED.items()),
    "n_advice": bool_sql(("partition by day", "order by country", "few countries", "sparse prices", "new rollup"), "what", "said"),
    "n_summary": f"select *, row_number() over (order by n desc, country nulls last) as place from (select (select count(*) from events) as rows, (select min({SQL_TIME_DIM['day']}) from events) as first_day, (select max({SQL_TIME_DIM['day']}) from events) as last_day, (select round(count(*) / count(distinct {SQL_TIME_DIM['day']}), 6) from events) as rows_a_day, country, count(*) as n from {catalog.AD_VIEW} group by country order by n desc, country nulls last limit 10)",
    "n_loader_stats": " union all ".join(f"select '{n}' as name, count(*) as rows, count(distinct {SQL_TIME_DIM.get(n, n)}) as \"distinct\", {catalog_sample if n == 'country' else 'null'} as sample from {catalog.AD_VIEW}" for n in ("type", "country", "advertiser_id", "publisher_id", "day") for catalog_sample in [f"(select string_agg(country, '|' order by country) from (select distinct country from {catalog.AD_VIEW} where country is not null order by country limit 5))"]),
}
