"""QuerySpecs as DataFrame plans, over detail rows or over a rollup's mergeable state."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismcube.functions.timedims import COARSER, TIME_DIMS, derived, time_dim
from prismcube.model import CubeModel, RollupDef
from prismcube.plans.spec import Aggregate, Condition, QuerySpec

ROW_COUNT = "row_count"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def event_time(model: CubeModel) -> Column:
    return F.timestamp_millis(F.col(model.time)) if model.epoch_millis else F.col(model.time)


def with_time_dims(events: DataFrame, model: CubeModel) -> DataFrame:
    """Adds the calendar dimensions that are not stored; unused ones are pruned."""
    missing = [d for d in TIME_DIMS if d not in events.columns]
    return events.withColumns({d: time_dim(d, event_time(model), model.week) for d in missing}) if missing else events


def predicate(c: Condition) -> Column:
    column = quoted(c.column)
    if c.op == "in":
        return column.isin(*c.value) if c.value else F.lit(False)
    if c.op == "between":
        return column.between(F.lit(c.value[0]), F.lit(c.value[1]))
    if c.value is None:
        return column.isNull() if c.op == "eq" else column.isNotNull()
    compare = {"eq": operator.eq, "neq": operator.ne, "lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}
    return compare[c.op](column, F.lit(c.value))


def filtered(df: DataFrame, where: tuple[Condition, ...]) -> DataFrame:
    return df.where(reduce(operator.and_, map(predicate, where))) if where else df


def from_rows(a: Aggregate) -> Column:
    """An aggregate over detail rows."""
    if a.column == "*":
        return F.count(F.lit(1)).alias(a.name)
    functions = {"SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "STDDEV": F.stddev_samp, "MEDIAN": F.median, "COUNT_DISTINCT": F.count_distinct, "APPROX_COUNT_DISTINCT": F.approx_count_distinct}
    return functions[a.func](quoted(a.column)).alias(a.name)


def from_state(a: Aggregate, model: CubeModel) -> Column:
    """The same over a rollup's state: sums stay null for groups without a value, counts are 0 then."""
    if a.column == "*":
        out = F.coalesce(F.sum(ROW_COUNT), F.lit(0))
    elif a.column not in model.measures:  # a dimension of the rollup
        rows = F.sum(F.when(quoted(a.column).isNotNull(), F.col(ROW_COUNT)))
        out = {"COUNT": F.coalesce(rows, F.lit(0)), "MIN": F.min(quoted(a.column)), "MAX": F.max(quoted(a.column))}[a.func]
    else:
        part = lambda name: F.col(f"{a.column}_{name}")
        out = {
            "SUM": F.sum(part("sum")),
            "AVG": F.sum(part("sum")) / F.nullif(F.sum(part("count")), F.lit(0)),
            "COUNT": F.coalesce(F.sum(part("count")), F.lit(0)),
            "MIN": F.min(part("min")),
            "MAX": F.max(part("max")),
        }[a.func]
    return out.alias(a.name)


def finished(df: DataFrame, spec: QuerySpec, count_star: str = "COUNT(*)") -> DataFrame:
    """Order (nulls last), limit, and the columns of ``select`` in its order."""
    if spec.order_by:
        df = df.orderBy(*(quoted(k.name).desc_nulls_last() if k.descending else quoted(k.name).asc_nulls_last() for k in spec.order_by))
    if spec.limit:
        df = df.limit(spec.limit)
    names = [x if isinstance(x, str) else x.name for x in spec.select]
    return df.select(*(quoted(n).alias(count_star if n == "COUNT(*)" else n) for n in names))


def over_rows(events: DataFrame, spec: QuerySpec, model: CubeModel, count_star: str = "COUNT(*)") -> DataFrame:
    """The query over detail rows."""
    rows = filtered(with_time_dims(events, model), spec.where)
    if spec.raw:
        return finished(rows, spec, count_star)
    groups = [quoted(g) for g in spec.group_by]
    if not spec.aggregates:
        return finished(rows.select(*groups).distinct(), spec, count_star)
    return finished(rows.groupBy(*groups).agg(*map(from_rows, spec.aggregates)), spec, count_star)


def with_coarser(rollup: DataFrame, definition: RollupDef, wanted: set[str], model: CubeModel) -> DataFrame:
    """Adds wanted calendar dimensions that the rollup has only in a finer form."""
    new = {}
    for dim in wanted - set(definition.dims):
        source = next((d for d in definition.dims if dim in COARSER.get(d, ())), None)
        if source:
            new[dim] = derived(dim, source, model.week)
    return rollup.withColumns(new) if new else rollup


def over_state(rollup: DataFrame, definition: RollupDef, spec: QuerySpec, model: CubeModel, count_star: str = "COUNT(*)") -> DataFrame:
    """The query over a rollup that covers it; groups are always aggregated again."""
    read = spec.dims | {a.column for a in spec.aggregates if a.column not in (*model.measures, "*")}
    rows = filtered(with_coarser(rollup, definition, read, model), spec.where)
    groups = [quoted(g) for g in spec.group_by]
    if not spec.aggregates:
        return finished(rows.select(*groups).distinct(), spec, count_star)
    return finished(rows.groupBy(*groups).agg(*(from_state(a, model) for a in spec.aggregates)), spec, count_star)
