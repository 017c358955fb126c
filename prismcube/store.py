"""The warehouse folder: rollups and detail rows as Parquet, and a manifest that says what there is.

Every write goes to a new folder; nothing that a reader may have open is changed. The manifest names the folders that
count and is replaced in one atomic rename, so a write that fails half-way leaves the warehouse as it was. Folders that
a manifest no longer names are removed one version later.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismcube.errors import WarehouseError
from prismcube.model import CubeModel, RollupDef
from prismcube.operators import rollups
from prismcube.operators.compile import with_time_dims

CODECS = {"lz4": "lz4_raw", "zstd": "zstd", "snappy": "snappy", "none": "none"}
#: Rollups of up to so many bytes are kept in memory once read, in a partition for each BYTES_A_PART.
CACHE_BYTES, BYTES_A_PART = 64 << 20, 8 << 20
#: Parts of a rollup from which on appending merges them into one.
COMPACT = 8


@dataclass
class Entry:
    dims: list[str]
    rows: int
    bytes: int
    compression: str
    partitioned_by: list[str] = field(default_factory=list)
    #: Folders under the warehouse; the rollup is what they give merged.
    parts: list[str] = field(default_factory=list)


@dataclass
class Manifest:
    table: str
    time_zone: str
    week: str
    measures: list[str]
    rollups: dict[str, Entry] = field(default_factory=dict)
    detail_rows: int | None = None
    detail_parts: list[str] = field(default_factory=list)
    #: column -> {distinct (approximate), nulls} of the detail rows that prepare wrote
    statistics: dict[str, dict] = field(default_factory=dict)
    #: stream -> the last of its batches that is in
    streams: dict[str, int] = field(default_factory=dict)
    #: folders that the version before had
    stale: list[str] = field(default_factory=list)
    version: int = 0
    written: float = 0.0


class Warehouse:
    """Paths are any that Spark can read and write."""

    def __init__(self, spark: SparkSession, path: str, model: CubeModel) -> None:
        self.spark, self.path, self.model = spark, path.rstrip("/"), model
        self._cached: dict[str, DataFrame] = {}
        self._dropped: list[str] = []
        self.refresh()

    def refresh(self) -> None:
        """Takes over what is stored now."""
        found = self._read(f"{self.path}/manifest.json")
        zone, model = self.spark.conf.get("spark.sql.session.timeZone"), self.model
        self.reset()
        self._dropped = []
        if found is None:
            self.manifest = Manifest(model.table, zone, model.week.value, list(model.measures))
            return
        raw = json.loads(found)
        self.manifest = Manifest(**{**raw, "rollups": {n: Entry(**e) for n, e in raw["rollups"].items()}})
        if self.manifest.time_zone != zone:
            raise WarehouseError(f"{self.path} was built in {self.manifest.time_zone}; the session is in {zone}")
        if (self.manifest.table, self.manifest.week, self.manifest.measures) != (model.table, model.week.value, list(model.measures)):
            raise WarehouseError(f"{self.path} was built for another model")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, path: str) -> str | None:
        p, fs = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _size(self, path: str) -> int:
        p, fs = self._fs(path)
        return fs.getContentSummary(p).getLength()

    def _remove(self, folders: list[str]) -> None:
        for folder in folders:
            p, fs = self._fs(f"{self.path}/{folder}")
            fs.delete(p, True)

    def save(self) -> None:
        """Makes what was written since the last time count, at once and whole."""
        now = self._read(f"{self.path}/manifest.json")
        if (json.loads(now)["version"] if now else 0) != self.manifest.version:
            raise WarehouseError(f"{self.path} was changed by another writer; refresh() and write again")
        before, self.manifest.stale = self.manifest.stale, self._dropped
        self.manifest.version, self.manifest.written = self.manifest.version + 1, time.time()
        beside, fs = self._fs(f"{self.path}/manifest-{uuid.uuid4().hex}.json")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(json.dumps(asdict(self.manifest), indent=1).encode()))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(beside, self._fs(f"{self.path}/manifest.json")[0], how)
        self._dropped = []
        self._remove(before)

    def _counted(self, frame: DataFrame, columns: dict) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return frame.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in columns.items())), seen

    def write_rollup(self, definition: RollupDef, frame: DataFrame, compression: str = "zstd", partition_by: tuple[str, ...] = (), files: int | None = None, add: bool = False, save: bool = True) -> DataFrame:
        """Writes one rollup (partitioned if asked), or with ``add`` a part of it, and returns it as stored.

        Without ``save`` it counts only from the next save() on.
        """
        if compression not in CODECS:
            raise WarehouseError(f"compression is one of {', '.join(CODECS)}, not {compression!r}")
        if missing := set(partition_by) - set(definition.dims):
            raise WarehouseError(f"{definition.name} can't be partitioned by {', '.join(sorted(missing))}")
        folder = f"rollups/{definition.name}/{uuid.uuid4().hex}"
        out = frame.repartition(*map(F.col, partition_by)) if partition_by else frame.coalesce(files) if files else frame
        out, seen = self._counted(out.sortWithinPartitions(*(d for d in definition.dims if d not in partition_by)), {})
        writer = out.write.option("compression", CODECS[compression])
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{folder}")
        old = self.manifest.rollups.get(definition.name)
        entry = Entry(list(definition.dims), seen.get["rows"], self._size(f"{self.path}/{folder}"), compression, list(partition_by), [folder])
        if add and old:
            entry = Entry(entry.dims, old.rows + entry.rows, old.bytes + entry.bytes, old.compression, old.partitioned_by, [*old.parts, folder])
        elif old:
            self._dropped += old.parts
        self.manifest.rollups[definition.name] = entry
        self._cached.pop(definition.name, None)
        if save:
            self.save()
        return self._open(definition, [folder])

    def _open(self, definition: RollupDef, parts: list[str]) -> DataFrame:
        """Parts of a rollup as they are stored. The schema is given, so '007' stays text in partition names, too."""
        kinds, measure = self.model.columns, lambda m: self.model.columns[m]
        state = [T.StructField(f"{m}_{x}", T.DoubleType() if x == "sum" else T.LongType() if x == "count" else measure(m)) for m in self.model.measures for x in ("sum", "count", "min", "max")]
        schema = T.StructType([*(T.StructField(d, kinds[d]) for d in definition.dims), *state, T.StructField(rollups.ROW_COUNT, T.LongType())])
        frames = [self.spark.read.schema(schema).parquet(f"{self.path}/{p}").select(*(f"`{c}`" for c in schema.names)) for p in parts]
        whole = frames[0]
        for f in frames[1:]:
            whole = whole.union(f)
        return whole

    def definition(self, name: str) -> RollupDef:
        if name not in self.manifest.rollups:
            raise WarehouseError(f"there is no rollup {name!r}; there are {', '.join(sorted(self.manifest.rollups)) or 'none'}")
        return RollupDef(name, tuple(self.manifest.rollups[name].dims))

    def stored(self, name: str) -> DataFrame:
        """A rollup's rows as they are stored, of all its parts."""
        return self._open(self.definition(name), self.manifest.rollups[name].parts)

    def _whole(self, name: str, rows: DataFrame) -> DataFrame:
        return rows if len(self.manifest.rollups[name].parts) == 1 else rollups.merge([rows], self.definition(name), self.model)

    def rollup(self, name: str, cache_bytes: int = CACHE_BYTES) -> DataFrame:
        """A rollup, its parts merged; small ones stay in memory, in so few partitions that grouping needs no shuffle."""
        definition = self.definition(name)
        if name not in self._cached:
            size, frame = self.manifest.rollups[definition.name].bytes, self._whole(name, self.stored(name))
            self._cached[name] = frame.coalesce(1 + size // BYTES_A_PART).cache() if size <= cache_bytes else frame
        return self._cached[name]

    def partition(self, name: str, key: str) -> DataFrame:
        """The rows of one partition of a partitioned rollup; other partitions' files are not read."""
        entry = self.manifest.rollups.get(name)
        if entry is None or not entry.partitioned_by:
            raise WarehouseError(f"there is no partitioned rollup {name!r}")
        return self._whole(name, self.stored(name).where(F.col(f"`{entry.partitioned_by[0]}`") == key))

    def partition_keys(self, name: str) -> list[str]:
        """From the folders' names alone."""
        self.partition(name, "")
        column, found = self.manifest.rollups[name].partitioned_by[0], set()
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        for part in self.manifest.rollups[name].parts:
            p, fs = self._fs(f"{self.path}/{part}")
            found |= {x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()}
        return sorted(unescape(x.split("=", 1)[1]) for x in found if x.startswith(f"{column}=") and not x.endswith("__HIVE_DEFAULT_PARTITION__"))

    def preload(self, cache_bytes: int = CACHE_BYTES) -> int:
        """Brings all small rollups into memory; returns how many."""
        small = [n for n, e in self.manifest.rollups.items() if e.bytes <= cache_bytes]
        for name in small:
            self.rollup(name, cache_bytes).count()
        return len(small)

    def reset(self) -> None:
        """Lets go of what is in memory."""
        for frame in self._cached.values():
            frame.unpersist()
        self._cached.clear()

    def write_detail(self, events: DataFrame, partitions: int | None = None, compression: str = "snappy", add: bool = False, save: bool = True) -> DataFrame:
        """All base columns and calendar dimensions, in the model's order, so that row groups can be skipped.

        Counts, approximate distinct counts and nulls of all columns are taken while the rows are written.
        """
        rows = with_time_dims(events, self.model)
        order = [f"`{c}`" for c in self.model.detail_order]
        if order:
            rows = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order, self.model.time)
        names = rows.columns
        each = {} if add else {k: x for i, n in enumerate(names) for k, x in ((f"d{i}", F.approx_count_distinct(f"`{n}`")), (f"n{i}", F.count_if(F.col(f"`{n}`").isNull())))}
        rows, seen = self._counted(rows, each)
        folder = f"detail/{uuid.uuid4().hex}"
        rows.write.option("compression", CODECS[compression]).parquet(f"{self.path}/{folder}")
        if add and self.manifest.detail_parts:
            self.manifest.detail_rows += seen.get["rows"]
            self.manifest.detail_parts.append(folder)
        else:
            self._dropped += self.manifest.detail_parts
            self.manifest.detail_rows, self.manifest.detail_parts = seen.get["rows"], [folder]
            self.manifest.statistics = {n: {"distinct": seen.get[f"d{i}"], "nulls": seen.get[f"n{i}"]} for i, n in enumerate(names)} if each else {}
        if save:
            self.save()
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")

    def detail(self) -> DataFrame:
        if not self.manifest.detail_parts:
            raise WarehouseError(f"{self.path} has no detail rows")
        return self.spark.read.parquet(*(f"{self.path}/{p}" for p in self.manifest.detail_parts))

    def statistics(self) -> DataFrame:
        """name, distinct (approximate), nulls of every column of the prepared detail rows."""
        return self.spark.createDataFrame([(n, s["distinct"], s["nulls"]) for n, s in sorted(self.manifest.statistics.items())], "name string, distinct long, nulls long")

    def compact(self, name: str, save: bool = True) -> None:
        """Merges a rollup's parts into one."""
        entry = self.manifest.rollups[name]
        self.write_rollup(self.definition(name), self._whole(name, self.stored(name)), entry.compression, tuple(entry.partitioned_by), save=save)

    def vacuum(self) -> int:
        """Removes folders that no manifest names (of writes that failed); no writer may be at work. Returns how many."""
        wanted = {*self.manifest.detail_parts, *self.manifest.stale, *(p for e in self.manifest.rollups.values() for p in e.parts)}
        found = []
        for top in ("detail", *(f"rollups/{n}" for n in self._folders("rollups"))):
            found += [f"{top}/{x}" for x in self._folders(top)]
        orphans = [x for x in found if x not in wanted]
        self._remove(orphans)
        return len(orphans)

    def _folders(self, top: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{top}")
        return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []

    def info(self) -> DataFrame:
        """name, dims, rows, bytes, compression, partitioned_by of every rollup and of the detail rows."""
        rows = [(n, ",".join(e.dims), e.rows, e.bytes, e.compression, ",".join(e.partitioned_by)) for n, e in sorted(self.manifest.rollups.items())]
        if self.manifest.detail_rows is not None:
            rows.append(("detail", "", self.manifest.detail_rows, sum(self._size(f"{self.path}/{p}") for p in self.manifest.detail_parts), "snappy", ""))
        return self.spark.createDataFrame(rows, "name string, dims string, rows long, bytes long, compression string, partitioned_by string")
