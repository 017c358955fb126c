"""Calendar dimensions of an event's time, one encoding for every route.

All are strings of fixed width, so that literals compare as text and coarser ones are prefixes of finer ones. ``week``
joins the calendar year to the ISO week number (2024-12-30 is 2024-W01); TRUNC gives the Monday instead.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class TimeEncoding(Enum):
    ISO_WEEK = "iso_week"
    TRUNC = "trunc"


TIME_DIMS = ("day", "hour", "minute", "week")
#: Which coarser dimensions a finer one gives.
COARSER = {"minute": ("hour", "day", "week"), "hour": ("day", "week"), "day": ("week",), "week": ()}


def _week(date: Column, encoding: TimeEncoding) -> Column:
    if encoding is TimeEncoding.TRUNC:
        return F.date_format(F.date_trunc("week", date), "yyyy-MM-dd")
    return F.format_string("%04d-W%02d", F.year(date), F.weekofyear(date))


def time_dim(name: str, ts: Column, encoding: TimeEncoding = TimeEncoding.ISO_WEEK) -> Column:
    """A dimension of a timestamp; null of null."""
    if name == "week":
        return F.when(ts.isNotNull(), _week(ts, encoding))
    form = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00", "minute": "yyyy-MM-dd HH:mm"}
    return F.date_format(ts, form[name])


def derived(name: str, source: str, encoding: TimeEncoding = TimeEncoding.ISO_WEEK) -> Column:
    """The coarser dimension ``name`` out of the finer column ``source``."""
    c = F.col(source)
    if name == "hour":
        return F.concat(F.substring(c, 1, 13), F.lit(":00"))
    day = F.substring(c, 1, 10)
    if name == "day":
        return day
    return F.when(c.isNotNull(), _week(F.to_date(day), encoding))


def day_of_year(ts: Column) -> Column:
    """'2024-153', as some older extracts name days."""
    return F.date_format(ts, "yyyy-DDD")


def sunday_week(ts: Column) -> Column:
    """Weeks that start on Sunday, counted from 0, as '2024-22'."""
    return F.format_string("%04d-%02d", F.year(ts), F.floor((F.dayofyear(ts) + 7 - F.dayofweek(ts)) / 7).cast("int"))


def calendar_day(year_and_day: Column) -> Column:
    """'2024-153' back to '2024-06-01'."""
    start = F.make_date(F.substring(year_and_day, 1, 4).cast("int"), F.lit(1), F.lit(1))
    return F.date_format(F.date_add(start, F.substring(year_and_day, 6, 3).cast("int") - 1), "yyyy-MM-dd")


def sql_time_dim(name: str, ts: str, encoding: TimeEncoding = TimeEncoding.ISO_WEEK) -> str:
    """The same as DuckDB SQL over a timestamp expression, for oracles."""
    if name == "week" and encoding is TimeEncoding.TRUNC:
        return f"strftime(date_trunc('week', {ts}), '%Y-%m-%d')"
    form = {"day": "%Y-%m-%d", "hour": "%Y-%m-%d %H:00", "minute": "%Y-%m-%d %H:%M", "week": "%Y-W%V"}
    return f"strftime({ts}, '{form[name]}')"


SQL_TIME_DIM = {d: sql_time_dim(d, "ts") for d in TIME_DIMS}
