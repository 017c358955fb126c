"""Rollups: mergeable state by dimensions, built directly, by grouping sets, or down a lattice; merged incrementally."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Executor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.functions.timedims import COARSER
from prismcube.model import CubeModel, RollupDef
from prismcube.operators.compile import ROW_COUNT, quoted, with_coarser, with_time_dims


def state_columns(model: CubeModel) -> list[str]:
    return [f"{m}_{part}" for m in model.measures for part in ("sum", "count", "min", "max")] + [ROW_COUNT]


def state(model: CubeModel) -> list:
    """The state of a group of rows: sum, non-null count, least and largest value of every measure, and the rows."""
    out = []
    for m in model.measures:
        c = quoted(m)
        out += [F.sum(c).cast("double").alias(f"{m}_sum"), F.count(c).alias(f"{m}_count"), F.min(c).alias(f"{m}_min"), F.max(c).alias(f"{m}_max")]
    return [*out, F.count(F.lit(1)).alias(ROW_COUNT)]


def merged_state(model: CubeModel) -> list:
    """The state of a group of states; sums, least and largest values skip nulls, so all-null groups stay null."""
    out = []
    for m in model.measures:
        out += [F.sum(f"{m}_sum").alias(f"{m}_sum"), F.sum(f"{m}_count").alias(f"{m}_count"), F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
    return [*out, F.sum(ROW_COUNT).alias(ROW_COUNT)]


def build(events: DataFrame, definition: RollupDef, model: CubeModel) -> DataFrame:
    """One rollup from detail rows."""
    return with_time_dims(events, model).groupBy(*map(quoted, definition.dims)).agg(*state(model))


def build_by_grouping_sets(events: DataFrame, definitions: Iterable[RollupDef], model: CubeModel) -> dict[str, DataFrame]:
    """All rollups from one scan and one shuffle: grouping sets, told apart by their grouping id."""
    definitions = list(definitions)
    dims = list(dict.fromkeys(d for r in definitions for d in r.dims))
    base = with_time_dims(events, model).select(*map(quoted, dims), *map(quoted, model.measures))
    sets = [[quoted(d) for d in r.dims] for r in definitions]
    whole = base.groupingSets(sets, *map(quoted, dims)).agg(F.grouping_id().alias("grouping"), *state(model))
    number = lambda r: sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in r.dims)
    return {r.name: whole.where(F.col("grouping") == number(r)).select(*r.dims, *state_columns(model)) for r in definitions}


def parent_of(definition: RollupDef, others: Iterable[RollupDef], model: CubeModel) -> RollupDef | None:
    """A finer rollup that gives this one: the one with the fewest dimensions, coarsest time first, then by name."""
    fine = lambda r: sum(1 + len(COARSER.get(d, ())) for d in r.dims)
    able = [r for r in others if r.name != definition.name and set(definition.dims) <= model.reachable(r.dims) and r.dims != definition.dims]
    return min(able, key=lambda r: (len(r.dims), fine(r), r.name), default=None)


def build_lattice(events: DataFrame, definitions: Iterable[RollupDef], model: CubeModel, keep=lambda name, df: df, pool: Executor | None = None) -> dict[str, DataFrame]:
    """All rollups, those that another one gives from that one, the others from detail rows.

    keep(name, frame) may store or cache a rollup before others are built on it and returns what to build on. With a
    pool, a rollup starts as soon as the one that it is built on is kept.
    """
    definitions = list(definitions)
    parents = {r.name: parent_of(r, definitions, model) for r in definitions}
    depth = lambda r: 0 if parents[r.name] is None else 1 + depth(parents[r.name])
    kept: dict[str, Callable[[], DataFrame]] = {}

    def make(r: RollupDef) -> DataFrame:
        parent = parents[r.name]
        return keep(r.name, roll_up(kept[parent.name](), parent, r, model) if parent else build(events, r, model))

    for r in sorted(definitions, key=depth):  # parents are submitted first, so none waits for a thread that waits for it
        if pool:
            kept[r.name] = pool.submit(make, r).result
        else:
            kept[r.name] = lambda frame=make(r): frame
    return {r.name: kept[r.name]() for r in definitions}


def roll_up(frame: DataFrame, parent: RollupDef, definition: RollupDef, model: CubeModel) -> DataFrame:
    """A coarser rollup out of a finer one."""
    return with_coarser(frame, parent, set(definition.dims), model).groupBy(*map(quoted, definition.dims)).agg(*merged_state(model))


def merge(parts: Iterable[DataFrame], definition: RollupDef, model: CubeModel) -> DataFrame:
    """Rollups of disjoint sets of rows as one; null keys are one group."""
    whole = reduce(lambda a, b: a.unionByName(b), parts)
    return whole.groupBy(*map(quoted, definition.dims)).agg(*merged_state(model))


def merge_by_join(left: DataFrame, right: DataFrame, definition: RollupDef, model: CubeModel) -> DataFrame:
    """merge() of two rollups written as a full outer join on all keys, null-safe."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, (F.col(f"a.`{d}`").eqNullSafe(F.col(f"b.`{d}`")) for d in definition.dims))
    both = lambda c: (F.col(f"a.`{c}`"), F.col(f"b.`{c}`"))
    added = lambda c: F.when(both(c)[0].isNull() & both(c)[1].isNull(), None).otherwise(sum(F.coalesce(x, F.lit(0)) for x in both(c)))
    how = {"sum": added, "count": added, "min": lambda c: F.least(*both(c)), "max": lambda c: F.greatest(*both(c))}
    values = [how[c.rsplit("_", 1)[1]](c).alias(c) for c in state_columns(model)]
    return a.join(b, on, "full_outer").select(*(F.coalesce(*both(d)).alias(d) for d in definition.dims), *values)


def rows_of(counts: Mapping[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in counts.items()}
