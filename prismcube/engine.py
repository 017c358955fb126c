"""The engine: prepares a warehouse, routes queries, runs batches."""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prismcube import sinks
from prismcube.errors import CubeError, QueryError, WarehouseError
from prismcube.model import AD_EVENTS, CubeModel, RollupDef
from prismcube.operators import compile as plans
from prismcube.operators import rollups
from prismcube.plans.router import DETAIL, Route, choose, obstacle
from prismcube.plans.spec import QuerySpec, parse
from prismcube.store import CACHE_BYTES, COMPACT, Warehouse

#: Tables of a warehouse that are written at the same time.
WRITERS = 6


@dataclass
class Outcome:
    """What became of one query of a batch."""

    name: str
    table: str | None
    rows: int | None
    seconds: float
    error: str | None = None


class Engine:
    """Answers queries from a warehouse, or from frames given directly (``frames``)."""

    def __init__(self, spark: SparkSession, model: CubeModel = AD_EVENTS, path: str | None = None, count_star: str = "COUNT(*)", null_text: bool = False) -> None:
        self.spark, self.model, self.count_star, self.null_text = spark, model, count_star, null_text
        self.warehouse = Warehouse(spark, path, model) if path else None
        self._frames: dict[str, DataFrame] = {}
        self._sizes: dict[str, int] = {}
        self._definitions: dict[str, RollupDef] = {}
        self._events: DataFrame | None = None

    @classmethod
    def frames(cls, spark: SparkSession, events: DataFrame, model: CubeModel = AD_EVENTS, rollup_names: Iterable[str] | None = (), sizes: dict[str, int] | None = None) -> Engine:
        """Without a warehouse: events, and rollups (None: all) as plans over them."""
        engine = cls(spark, model)
        engine._events = events
        names = [r.name for r in model.rollups] if rollup_names is None else list(rollup_names)
        for i, name in enumerate(names):
            engine.add_rollup(model.rollup(name), rollups.build(events, model.rollup(name), model), (sizes or {}).get(name, i))
        return engine

    def add_rollup(self, definition: RollupDef, frame: DataFrame, rows: int) -> None:
        self._definitions[definition.name], self._frames[definition.name], self._sizes[definition.name] = definition, frame, rows

    def prepare(self, events: DataFrame, rollup_names: Iterable[str] | None = None, method: str = "lattice", compression: str = "zstd", partition_minutes: bool = True, detail: bool = True) -> dict[str, int]:
        """Builds rollups (None: all of the model) and detail rows; returns the rollups' row counts.

        The detail rows are written first and rollups are built from them, so the source is read once; rollups that don't
        build on each other are written at the same time. Nothing counts before all of it is written.
        """
        if self.warehouse is None:
            raise WarehouseError("this engine has no warehouse")
        if method not in ("lattice", "grouping_sets", "direct"):
            raise WarehouseError(f"method is lattice, grouping_sets or direct, not {method!r}")
        house = self.warehouse
        house.refresh()
        base = house.write_detail(events, save=False) if detail else events
        names = [r.name for r in self.model.rollups] if rollup_names is None else list(rollup_names)
        wanted = [self.model.rollup(n) for n in names]

        def keep(name: str, frame: DataFrame) -> DataFrame:
            definition = self.model.rollup(name)
            by = ("day",) if partition_minutes and "minute" in definition.dims else ()
            if by:
                definition = RollupDef(name, ("day", *definition.dims))
                frame = plans.with_coarser(frame, self.model.rollup(name), {"day"}, self.model)
            return house.write_rollup(definition, frame, compression, by, save=False)

        with ThreadPoolExecutor(WRITERS) as pool:
            if method == "lattice":
                rollups.build_lattice(base, wanted, self.model, keep, pool)
            else:
                built = rollups.build_by_grouping_sets(base, wanted, self.model) if method == "grouping_sets" else {r.name: rollups.build(base, r, self.model) for r in wanted}
                for done in [pool.submit(keep, name, frame) for name, frame in built.items()]:
                    done.result()
        house.save()
        return {n: house.manifest.rollups[n].rows for n in names}

    def append(self, events: DataFrame, batch: tuple[str, int] | None = None) -> bool:
        """Adds more events, disjoint from those before: their rows, and their state as a new part of every rollup.

        Only the new events are read; parts are merged when a rollup is read, and into one when there are COMPACT of them.
        All of it counts at once. batch: a stream and the number of its batch; one that is in already is not added again.
        Returns whether the events were added.
        """
        if self.warehouse is None:
            raise WarehouseError("this engine has no warehouse")
        house = self.warehouse
        house.refresh()
        if batch and house.manifest.streams.get(batch[0], -1) >= batch[1]:
            return False

        def add(name: str) -> None:
            entry, definition = house.manifest.rollups[name], house.definition(name)
            house.write_rollup(definition, rollups.build(events, definition, self.model), entry.compression, tuple(entry.partitioned_by), add=True, save=False)
            if len(house.manifest.rollups[name].parts) >= COMPACT:
                house.compact(name, save=False)

        def add_rows() -> None:
            house.write_detail(events, add=True, save=False)

        with ThreadPoolExecutor(WRITERS) as pool:
            work = [pool.submit(add, name) for name in list(house.manifest.rollups)]
            if house.manifest.detail_parts:
                work.append(pool.submit(add_rows))
            for done in work:
                done.result()
        if batch:
            house.manifest.streams[batch[0]] = batch[1]
        house.save()
        return True

    @property
    def definitions(self) -> dict[str, RollupDef]:
        own = {n: RollupDef(n, tuple(e.dims)) for n, e in self.warehouse.manifest.rollups.items()} if self.warehouse else {}
        return {**own, **self._definitions}

    @property
    def sizes(self) -> dict[str, int]:
        return {**({n: e.rows for n, e in self.warehouse.manifest.rollups.items()} if self.warehouse else {}), **self._sizes}

    def spec(self, query: dict | str | QuerySpec) -> QuerySpec:
        return query if isinstance(query, QuerySpec) else parse(query, self.model, self.null_text)

    def route(self, query: dict | str | QuerySpec) -> Route:
        """The table that answers a query, what it derives, and why the others don't."""
        spec = self.spec(query)
        return choose(spec, self.sizes, self.definitions, self.model)

    def query(self, query: dict | str | QuerySpec, route: str = "auto") -> DataFrame:
        """The answer, as a plan. route: auto, detail, rollup (no detail), or a rollup's name; the answer is the same."""
        spec = self.spec(query)
        table = DETAIL if route == DETAIL else self.route(spec).table if route in ("auto", "rollup") else route
        if table == DETAIL:
            if route == "rollup":
                raise QueryError("no rollup answers this query")
            return plans.over_rows(self.events(), spec, self.model, self.count_star)
        if table not in self.definitions:
            raise QueryError(f"there is no rollup {table!r}")
        if why := obstacle(spec, self.definitions[table], self.model):
            raise QueryError(f"{table} can't answer this query: {why}")
        return plans.over_state(self.rollup(table), self.definitions[table], spec, self.model, self.count_star)

    def events(self) -> DataFrame:
        if self._events is not None:
            return self._events
        if self.warehouse is None:
            raise WarehouseError("there are no events")
        return self.warehouse.detail()

    def rollup(self, name: str) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        return self.warehouse.rollup(name)

    def preload(self, cache_bytes: int = CACHE_BYTES) -> int:
        return self.warehouse.preload(cache_bytes) if self.warehouse else 0

    def run_batch(self, queries: Iterable[tuple[str, dict]], out: str, suffix: str = ".csv", route: str = "auto") -> list[Outcome]:
        """Runs queries one by one; each writes {name}{suffix}; one that fails doesn't stop the others."""
        done = []
        for name, q in queries:
            began, table = time.perf_counter(), None
            try:
                spec = self.spec(q)
                table = self.route(spec).table if route == "auto" else route
                rows = sinks.write_csv(self.query(spec, route), f"{out}/{name}{suffix}")
                done.append(Outcome(name, table, rows, time.perf_counter() - began))
            except Exception as e:  # noqa: BLE001  a query's failure is its outcome
                done.append(Outcome(name, table, None, time.perf_counter() - began, f"{type(e).__name__}: {e}"))
        sinks.write_timings([vars(o) for o in done], f"{out}/timing_results.json")
        return done

    def validate(self) -> list[tuple[str, bool, str]]:
        """Checks of a prepared warehouse: (what, passed, note)."""
        checks = []
        if self.warehouse is None:
            return [("warehouse", False, "none is set")]
        manifest = self.warehouse.manifest
        missing = [r.name for r in self.model.rollups if r.name not in manifest.rollups]
        checks.append(("rollups", not missing, f"missing: {', '.join(missing)}" if missing else f"{len(manifest.rollups)} found"))
        for name, entry in sorted(manifest.rollups.items()):
            try:
                rows = self.warehouse.stored(name).count()
                checks.append((name, rows == entry.rows, f"{rows} rows"))
            except Exception as e:  # noqa: BLE001
                checks.append((name, False, str(e).splitlines()[0]))
        try:
            rows = self.warehouse.detail().count()
            checks.append(("detail", rows == manifest.detail_rows, f"{rows} rows"))
        except CubeError as e:
            checks.append(("detail", False, str(e)))
        smoke = {"select": [{"COUNT": "*"}]}
        try:
            counts = {r: self.query(smoke, r).first()[0] for r in ("rollup", DETAIL)}
            checks.append(("smoke query", len(set(counts.values())) == 1, f"{counts}"))
        except CubeError as e:
            checks.append(("smoke query", False, str(e)))
        return checks
