"""The query language: small JSON documents, read into a QuerySpec and checked before anything runs.

query    := {"select": [item+], "from": table?, "where": [cond*]?, "group_by": [column*]?, "order_by": [key*]?, "limit": int?}
item     := column | {FUNC: column | "*", ...}
cond     := {"col": column, "op": eq|neq|ne|lt|lte|gt|gte|in|between, "val": scalar | list | null}
key      := {"col": column | "FUNC(column)", "dir": "asc" | "desc"?}

Conditions are joined by AND. A null value means IS NULL (eq) or IS NOT NULL (neq). A limit of 0 is no limit. Grouping
without aggregates gives the distinct groups; neither gives the raw rows. Output follows the order of ``select``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from prismcube.errors import QueryError
from prismcube.functions.timedims import TIME_DIMS, sql_time_dim
from prismcube.model import CubeModel

#: Functions that rollups can answer, and those that need the detail table.
MERGEABLE = ("SUM", "AVG", "COUNT", "MIN", "MAX")
DETAIL_ONLY = ("STDDEV", "MEDIAN", "COUNT_DISTINCT", "APPROX_COUNT_DISTINCT")
COMPARE = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
ALIASES = {"ne": "neq"}
NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)


@dataclass(frozen=True)
class Aggregate:
    func: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.func}({self.column})"


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class OrderKey:
    item: str | Aggregate
    descending: bool

    @property
    def name(self) -> str:
        return self.item if isinstance(self.item, str) else self.item.name


@dataclass(frozen=True)
class QuerySpec:
    select: tuple[str | Aggregate, ...]
    table: str
    where: tuple[Condition, ...]
    group_by: tuple[str, ...]
    order_by: tuple[OrderKey, ...]
    limit: int | None

    @property
    def aggregates(self) -> tuple[Aggregate, ...]:
        """Selected ones and those only ordered by, each once."""
        found = [*self.select, *(k.item for k in self.order_by)]
        return tuple(dict.fromkeys(x for x in found if isinstance(x, Aggregate)))

    @property
    def raw(self) -> bool:
        return not self.group_by and not self.aggregates

    @property
    def dims(self) -> set[str]:
        """Columns that grouping and filtering read."""
        return set(self.group_by) | {c.column for c in self.where}


def parse(query: dict | str, model: CubeModel, null_text: bool = False) -> QuerySpec:
    """Reads and checks a query document. null_text: the value 'NULL' of eq and neq means null, too."""
    if isinstance(query, str):
        try:
            query = json.loads(query)
        except json.JSONDecodeError as e:
            raise QueryError(f"not a JSON document: {e}") from e
    if not isinstance(query, dict):
        raise QueryError(f"a query is an object, not {type(query).__name__}")
    if unknown := set(query) - {"select", "from", "where", "group_by", "order_by", "limit"}:
        raise QueryError(f"unknown parts: {', '.join(sorted(unknown))}")
    table = query.get("from", model.table)
    if table != model.table:
        raise QueryError(f"unknown table {table!r}; there is {model.table!r}")
    select = tuple(dict.fromkeys(x for item in _list(query, "select") for x in _items(item, model)))
    if not select:
        raise QueryError("select is missing or empty")
    group_by = tuple(dict.fromkeys(_column(c, model) for c in _list(query, "group_by")))
    where = tuple(_condition(c, model, null_text) for c in _list(query, "where"))
    order_by = tuple(_order_key(k, model) for k in _list(query, "order_by"))
    limit = query.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise QueryError(f"limit must be a number of rows, not {limit!r}")
    spec = QuerySpec(select, table, where, group_by, order_by, limit or None)
    if not spec.raw:
        for x in (*select, *(k.item for k in order_by)):
            if isinstance(x, str) and x not in group_by:
                raise QueryError(f"{x} is neither grouped by nor aggregated")
    return spec


def _list(query: dict, part: str) -> list:
    value = query.get(part) or []
    if not isinstance(value, list):
        raise QueryError(f"{part} must be a list")
    return value


def _column(name: Any, model: CubeModel) -> str:
    if not isinstance(name, str) or name not in model.columns:
        raise QueryError(f"unknown column {name!r}")
    return name


def _aggregate(func: Any, column: Any, model: CubeModel) -> Aggregate:
    name = str(func).upper()
    if name not in (*MERGEABLE, *DETAIL_ONLY):
        raise QueryError(f"unknown function {func!r}")
    if column == "*":
        if name != "COUNT":
            raise QueryError(f"{name}(*) has no meaning")
        return Aggregate(name, "*")
    _column(column, model)
    if name in ("SUM", "AVG", "STDDEV", "MEDIAN") and not isinstance(model.columns[column], NUMBERS):
        raise QueryError(f"{name} needs a number; {column} is {model.columns[column].simpleString()}")
    return Aggregate(name, column)


def _items(item: Any, model: CubeModel) -> list[str | Aggregate]:
    if isinstance(item, dict):
        return [_aggregate(f, c, model) for f, c in item.items()]
    return [_column(item, model)]


def _order_key(key: Any, model: CubeModel) -> OrderKey:
    if not isinstance(key, dict) or "col" not in key:
        raise QueryError(f"an order key is an object with col, not {key!r}")
    way = str(key.get("dir") or "asc").lower()
    if way not in ("asc", "desc"):
        raise QueryError(f"dir must be asc or desc, not {key['dir']!r}")
    name = key["col"]
    if isinstance(name, str) and name.lower() == "count_star()":
        name = "COUNT(*)"
    found = re.fullmatch(r"\s*(\w+)\s*\(\s*(\*|\w+)\s*\)\s*", name) if isinstance(name, str) else None
    return OrderKey(_aggregate(*found.groups(), model) if found else _column(name, model), way == "desc")


def _condition(cond: Any, model: CubeModel, null_text: bool = False) -> Condition:
    if not isinstance(cond, dict) or not {"col", "op"} <= set(cond):
        raise QueryError(f"a condition is an object with col, op and val, not {cond!r}")
    column, op, value = _column(cond["col"], model), str(cond["op"]).lower(), cond.get("val")
    op, kind = ALIASES.get(op, op), model.columns[column]
    if null_text and value == "NULL" and op in ("eq", "neq"):
        value = None
    if op == "in":
        values = value if isinstance(value, list | tuple) else [value]
        if any(v is None for v in values):
            raise QueryError("in takes values, not null")
        return Condition(column, op, tuple(literal(v, kind) for v in values))
    if op == "between":
        if not isinstance(value, list | tuple) or len(value) != 2 or None in value:
            raise QueryError(f"between takes two values, not {value!r}")
        return Condition(column, op, tuple(literal(v, kind) for v in value))
    if op not in COMPARE:
        raise QueryError(f"unknown operator {cond['op']!r}")
    if value is None:
        if op not in ("eq", "neq"):
            raise QueryError(f"{op} needs a value")
        return Condition(column, op, None)
    return Condition(column, op, literal(value, kind))


def literal(value: Any, kind: T.DataType) -> Any:
    """The value as the column's type has it, so that no cast can fail or mislead later."""
    try:
        if isinstance(value, bool | list | dict):
            raise ValueError
        if isinstance(kind, T.IntegerType | T.LongType | T.ShortType | T.ByteType):
            number = float(value)
            if number != int(number):
                return number
            return int(value) if not isinstance(value, str) or re.fullmatch(r"\s*[-+]?\d+\s*", value) else int(number)
        if isinstance(kind, T.DoubleType | T.FloatType | T.DecimalType):
            return float(value)
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            return dt.datetime.fromisoformat(str(value))
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(str(value))
        return str(value)
    except (ValueError, OverflowError) as e:
        raise QueryError(f"{value!r} is no {kind.simpleString()}") from e


def to_sql(spec: QuerySpec, model: CubeModel, source: str | None = None) -> str:
    """The query as DuckDB's SQL over the base columns, for oracles; calendar dimensions are spelled out as the model has them."""
    ts = f"make_timestamp({model.time} * 1000)" if model.epoch_millis else model.time
    time = lambda c: sql_time_dim(c, ts, model.week) if c in TIME_DIMS and c not in model.schema.names else c
    agg = {"COUNT_DISTINCT": "count(distinct {})", "APPROX_COUNT_DISTINCT": "approx_count_distinct({})", "STDDEV": "stddev_samp({})"}
    shown = lambda x: f'{time(x)} as "{x}"' if isinstance(x, str) else f'{expr(x)} as "{x.name}"'
    expr = lambda a: agg.get(a.func, a.func.lower() + "({})").format("*" if a.column == "*" else time(a.column))
    out = [f"select {', '.join(map(shown, spec.select))}", f"from {source or spec.table}"]
    if spec.where:
        out.append("where " + " and ".join(_sql_condition(time(c.column), c) for c in spec.where))
    if spec.group_by:
        out.append("group by " + ", ".join(map(time, spec.group_by)))
    if spec.order_by:
        out.append("order by " + ", ".join(f"{time(k.item) if isinstance(k.item, str) else expr(k.item)} {'desc' if k.descending else 'asc'} nulls last" for k in spec.order_by))
    if spec.limit:
        out.append(f"limit {spec.limit}")
    return "\n".join(out)


def _sql_value(value: Any) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, dt.datetime):
        return f"timestamp '{value.isoformat(sep=' ')}'"
    return repr(value) if not isinstance(value, dt.date) else f"date '{value.isoformat()}'"


def _sql_condition(column: str, c: Condition) -> str:
    if c.op == "in":
        return f"{column} in ({', '.join(map(_sql_value, c.value))})" if c.value else "false"
    if c.op == "between":
        return f"{column} between {_sql_value(c.value[0])} and {_sql_value(c.value[1])}"
    if c.value is None:
        return f"{column} is {'not ' if c.op == 'neq' else ''}null"
    return f"{column} {COMPARE[c.op]} {_sql_value(c.value)}"
