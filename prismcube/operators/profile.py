"""Profiles of workloads and data, and advice on rollups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.functions.timedims import TIME_DIMS
from prismcube.model import CubeModel
from prismcube.operators.compile import quoted, with_time_dims
from prismcube.plans.spec import Aggregate, QuerySpec, parse


@dataclass
class Workload:
    """How often queries read what."""

    queries: int = 0
    where: Counter = field(default_factory=Counter)
    ops: Counter = field(default_factory=Counter)
    group: Counter = field(default_factory=Counter)
    patterns: Counter = field(default_factory=Counter)
    selected: Counter = field(default_factory=Counter)
    aggregates: Counter = field(default_factory=Counter)
    order: Counter = field(default_factory=Counter)
    time_dims: Counter = field(default_factory=Counter)
    needs: Counter = field(default_factory=Counter)


def workload(queries: Iterable[dict | QuerySpec], model: CubeModel) -> Workload:
    out = Workload()
    for q in queries:
        spec = q if isinstance(q, QuerySpec) else parse(q, model)
        out.queries += 1
        out.where.update({c.column for c in spec.where})
        out.ops.update(c.op for c in spec.where)
        out.group.update(spec.group_by)
        out.patterns[tuple(sorted(spec.group_by))] += 1
        out.selected.update(x for x in spec.select if isinstance(x, str))
        out.aggregates.update(x.name for x in spec.select if isinstance(x, Aggregate))
        out.order.update(k.name for k in spec.order_by)
        out.time_dims.update(spec.dims & set(TIME_DIMS))
        out.needs[tuple(sorted(spec.dims))] += 1
    return out


def columns(events: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """name, rows, distinct (exact, without null), null_pct of columns, in one pass."""
    names = list(names) if names is not None else events.columns
    each = [x for n in names for x in (F.count_distinct(quoted(n)).alias(f"{n}|d"), F.count(quoted(n)).alias(f"{n}|n"))]
    whole = events.agg(F.count(F.lit(1)).alias("rows"), *each)
    null_pct = lambda n: F.when(F.col("rows") > 0, 100 * (F.col("rows") - F.col(f"`{n}|n`")) / F.col("rows"))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col("rows"), F.col(f"`{n}|d`").alias("distinct"), null_pct(n).alias("null_pct")) for n in names))
    return whole.select(F.inline(rows))


def samples(events: DataFrame, column: str, n: int = 20) -> list:
    """Some distinct values of a column, in order."""
    return [r[0] for r in events.where(quoted(column).isNotNull()).select(quoted(column)).distinct().orderBy(quoted(column)).limit(n).collect()]


#: Groupings that a distribution counts.
DISTRIBUTION = (("type",), ("country",), ("day",), ("hour",), ("day", "type"), ("country", "type"), ("advertiser_id", "type"), ("publisher_id", "type"), ("day", "country"))


def distribution(events: DataFrame, model: CubeModel, groupings: Iterable[tuple[str, ...]] = DISTRIBUTION) -> DataFrame:
    """grouping, key (values joined by '|', null as empty), n of every group, from one scan; rows without ids left out."""
    groupings = [tuple(g) for g in groupings]
    dims = list(dict.fromkeys(d for g in groupings for d in g))
    base = with_time_dims(events, model).select(*map(quoted, dims))
    whole = base.groupingSets([[quoted(d) for d in g] for g in groupings], *map(quoted, dims)).agg(F.grouping_id().alias("grouping_number"), F.count(F.lit(1)).alias("n"))
    name, key, keep = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(True)
    for g in groupings:
        number = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in g)
        own = F.col("grouping_number") == number
        name = F.when(own, F.lit("|".join(g))).otherwise(name)
        key = F.when(own, F.concat_ws("|", *(F.coalesce(quoted(d).cast("string"), F.lit("")) for d in g))).otherwise(key)
        for d in g:
            if d.endswith("_id"):
                keep = keep & (~own | quoted(d).isNotNull())
    return whole.where(keep).select(name.alias("grouping"), key.alias("key"), "n")


def summary(events: DataFrame, model: CubeModel, top: int = 10) -> dict:
    """Rows, time range, rows a day, the top countries, cardinalities."""
    rows = with_time_dims(events, model)
    total, first, last, days = rows.agg(F.count(F.lit(1)), F.min("day"), F.max("day"), F.count_distinct("day")).first()
    out = {"rows": total, "first_day": first, "last_day": last, "rows_a_day": total / days if days else None}
    if "country" in rows.columns:
        ranked = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("country").asc_nulls_last()).limit(top)
        out["top_countries"] = [(r.country, r.n) for r in ranked.collect()]
    return out


def selectivity(spec: QuerySpec, distinct: dict[str, int]) -> float:
    """The share of rows that a query is expected to read, its conditions taken as independent."""
    share = 1.0
    for c in spec.where:
        n = max(1, distinct.get(c.column, 1))
        if c.op == "eq":
            part = 1 / n
        elif c.op == "neq":
            part = 1 - 1 / n
        elif c.op == "in":
            part = len(c.value) / n
        elif c.op == "between":
            part = 5 / 366 if c.column == "day" else 0.25
        else:
            part = 1 / 3
        share *= min(1.0, part)
    return share


def scan_estimates(specs: Iterable[QuerySpec], total: int, distinct: dict[str, int]) -> list[tuple[int, int]]:
    """(rows read, groups at most) of every query over detail rows."""
    out = []
    for s in specs:
        groups = 1
        for g in s.group_by:
            groups *= max(1, distinct.get(g, 1))
        read = round(total * selectivity(s, distinct))
        out.append((read, min(groups, read)))
    return out


def advice(w: Workload, profile: dict[str, tuple[int, float]], model: CubeModel) -> list[str]:
    """What the workload and the columns' (distinct, null_pct) speak for."""
    out = []
    for column, n in w.where.most_common():
        share = n / max(1, w.queries)
        if share >= 0.6:
            out.append(f"partition detail rows by {column}: {share:.0%} of queries filter on it")
        elif share >= 0.3:
            out.append(f"order detail rows by {column}: {share:.0%} of queries filter on it")
    for column, (distinct, null_pct) in profile.items():
        if column in w.where and distinct < 1000:
            out.append(f"{column} has {distinct} values: dictionary pages and row-group bounds will skip most of it")
        if null_pct > 50:
            out.append(f"{column} is {null_pct:.0f} % null")
    have = [set(model.reachable(r.dims)) for r in model.rollups]
    for needs, n in w.needs.most_common(5):
        if needs and not any(set(needs) <= h for h in have):
            out.append(f"add a rollup by {', '.join(needs)}: {n} of {w.queries} queries need it")
    return out
