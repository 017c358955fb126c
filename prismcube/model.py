"""What a cube is about: one fact table, its time, dimensions and measures, and the rollups worth keeping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from prismcube.functions.timedims import COARSER, TIME_DIMS, TimeEncoding


@dataclass(frozen=True)
class RollupDef:
    """A rollup: every combination of its dimensions with the mergeable state of every measure."""

    name: str
    dims: tuple[str, ...]


@dataclass(frozen=True)
class CubeModel:
    table: str
    time: str
    epoch_millis: bool
    schema: T.StructType
    measures: tuple[str, ...]
    rollups: tuple[RollupDef, ...]
    detail_order: tuple[str, ...] = ()
    week: TimeEncoding = TimeEncoding.ISO_WEEK
    extra: tuple[RollupDef, ...] = field(default=())

    @property
    def columns(self) -> dict[str, T.DataType]:
        """Base columns and calendar dimensions with their types."""
        return {f.name: f.dataType for f in self.schema.fields} | {d: T.StringType() for d in TIME_DIMS}

    def rollup(self, name: str) -> RollupDef:
        for r in (*self.rollups, *self.extra):
            if r.name == name:
                return r
        raise KeyError(name)

    def reachable(self, dims: tuple[str, ...]) -> set[str]:
        """Dimensions that a rollup on ``dims`` can answer: its own and coarser calendar ones."""
        return set(dims) | {c for d in dims for c in COARSER.get(d, ())}


def _rollups(*names_and_dims: tuple[str, str]) -> tuple[RollupDef, ...]:
    return tuple(RollupDef(n, tuple(d.split())) for n, d in names_and_dims)


KINDS = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType, "timestamp_ntz": T.TimestampNTZType}


def _fields(text: str) -> T.StructType:
    """Without a session, so that models can be declared at import."""
    return T.StructType([T.StructField(name, KINDS[kind]()) for name, kind in map(str.split, text.split(","))])


#: Advertising events: serves, impressions, clicks and purchases.
AD_EVENTS = CubeModel(
    table="events",
    time="ts",
    epoch_millis=True,
    schema=_fields("ts long, type string, auction_id string, advertiser_id int, publisher_id int, bid_price double, user_id long, total_price double, country string"),
    measures=("bid_price", "total_price"),
    rollups=_rollups(
        ("day_type", "day type"),
        ("hour_type", "hour type"),
        ("minute_type", "minute type"),
        ("week_type", "week type"),
        ("country_type", "country type"),
        ("advertiser_type", "advertiser_id type"),
        ("publisher_type", "publisher_id type"),
        ("day_country_type", "day country type"),
        ("day_advertiser_type", "day advertiser_id type"),
        ("hour_country_type", "hour country type"),
        ("day_publisher_country_type", "day publisher_id country type"),
    ),
    detail_order=("week", "country", "type"),
    extra=_rollups(
        ("day_publisher_type", "day publisher_id type"),
        ("week_country_type", "week country type"),
        ("publisher_country_type", "publisher_id country type"),
        ("advertiser_country_type", "advertiser_id country type"),
        ("day_country_advertiser_type", "day country advertiser_id type"),
    ),
)

#: Presets of rollup names for Engine.prepare: by one dimension and type, and by several.
CORE = tuple(r.name for r in AD_EVENTS.rollups if len(r.dims) == 2)
COMBINED = ("day_country_type", "day_advertiser_type", "hour_country_type")

#: Order lines: a second model, to keep the engine general.
ORDER_LINES = CubeModel(
    table="lineitem",
    time="l_shipdate",
    epoch_millis=False,
    schema=_fields("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
    measures=("l_quantity", "l_extendedprice"),
    rollups=_rollups(("day_status", "day l_linestatus"), ("flag_status", "l_returnflag l_linestatus"), ("week_flag", "week l_returnflag"), ("supplier_flag", "l_suppkey l_returnflag")),
    detail_order=("week", "l_returnflag"),
)
