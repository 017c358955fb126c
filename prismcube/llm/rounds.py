"""Linking the members that meet in buckets: pivots first, then tiles, without emitting the pairs of a bucket.

1. Every member of a bucket is compared with the bucket's pivot, its smallest member. What is linked becomes one
   component. A bucket whose members are all in one component is done; from the others the pivot goes, as it has been
   compared with all of them.
2. Members of buckets that still hold several components are laid into tiles of bounded size, ordered by cluster
   (component of the buckets that are left) and component. A tile is compared with itself, and with those tiles of its
   cluster that hold another component. Members of one component are never compared, so a group of copies that has
   been joined costs only its comparison with the few that are not in it.

So every two members that share a bucket are compared or in one component already. The first step gives a row for each
link to a pivot, a tile pair a forest: no output grows with the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.llm.common import partitions, stored, tidy
from prismcube.llm.components import components

#: Rows of buckets for each task that compares members with pivots.
ROWS_A_TASK = 1 << 12
#: Members and payload bytes in a tile, at most (a larger member is a tile of its own).
MEMBERS, BYTES = 512, 4 << 20

#: What some payloads say, and which members (of others, by place) the member at a place (of some) is linked with.
Read = Callable[[list[bytes]], Any]
Same = Callable[[Any, int, Any, np.ndarray], np.ndarray]


class Tile(NamedTuple):
    reps: list[int]
    clusters: np.ndarray
    owns: np.ndarray  # components so far
    members: Any


def meeting(buckets: DataFrame) -> DataFrame:
    """bucket, rep and pivot (the smallest rep) of every member of the buckets (bucket, rep) that have several."""
    ends = buckets.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("high")).where("pivot < high").select("bucket", "pivot")
    return buckets.join(ends, "bucket")


def unresolved(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that hold several components without their pivots: bucket, rep, own (component so far), pivot (the next one), first (its component)."""
    own = met.where("rep > pivot").select("bucket", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("own"))
    ends = own.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.min_by("own", "rep").alias("first"), F.min("own").alias("least"), F.max("own").alias("most")).where("least < most")
    return own.join(ends.select("bucket", "pivot", "first"), "bucket")


def confirmed(pairs: DataFrame, payloads: DataFrame, read: Read, same: Same, tasks: int) -> DataFrame:
    """Of pairs (u, v) those that are linked, in so many tasks. A u with a share of all pairs is split by the skew join."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, us, vs = [], b.column(0).to_pylist(), b.column(1).to_pylist()
            for u, rows in groupby(range(b.num_rows), us.__getitem__):
                rows = list(rows)
                for at in range(0, len(rows), MEMBERS):
                    some = rows[at : at + MEMBERS]
                    hit = same(read([b.column(2)[some[0]].as_py()]), 0, read([b.column(3)[k].as_py() for k in some]), np.arange(len(some)))
                    out += [(u, vs[k]) for k, x in zip(some, hit.tolist()) if x]
            yield edges(out)

    side = lambda name: payloads.select(F.col("rep").alias(name), F.col("payload").alias(f"p{name}"))
    both = pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "pu", "pv").coalesce(tasks)
    return both.mapInArrow(lambda b: tidy(check(b)), "u long, v long")


def edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])


def forest(a: Tile, b: Tile | None, same: Same) -> list[tuple[int, int]]:
    """Links inside a tile or between two that join what is not joined yet."""
    other = a if b is None else b
    mine, out = a.owns.copy(), []
    theirs = mine if b is None else b.owns.copy()
    places = {int(c): np.flatnonzero(other.clusters == c) for c in np.unique(other.clusters)}
    for i, c in enumerate(a.clusters.tolist()):
        js = places.get(c, np.zeros(0, np.int64))
        js = js[js > i] if b is None else js
        js = js[theirs[js] != mine[i]]
        for j in js[same(a.members, i, other.members, js)].tolist() if len(js) else ():
            x, y = int(mine[i]), int(theirs[j])
            if x != y:
                for labels in (mine, theirs):  # one array for one tile
                    labels[labels == max(x, y)] = min(x, y)
                out.append((a.reps[i], other.reps[j]))
    return out


def tiled(items: DataFrame, read: Read, same: Same) -> DataFrame:
    """u, v: links among items (rep, cluster, own, payload) that join components of a cluster."""
    items = stored(items, "members")
    n = max(1, min(partitions(items.sparkSession), -(-items.count() // MEMBERS)))
    columns = ["reps", "clusters", "owns", "payloads"]
    span_kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("cluster", "least", "most")]))

    def cut(batches):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def tile():
            owns: dict[int, list[int]] = {}
            for r in held:
                owns.setdefault(r[1], []).append(r[2])
            spans = [{"cluster": c, "least": min(x), "most": max(x)} for c, x in owns.items()]
            lists = [[number], [spans], *([[r[k] for r in held]] for k in range(4))]
            kinds = (pa.int64(), span_kind, *(pa.list_(pa.int64()),) * 3, pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(lists, kinds)], names=["tile", "spans", *columns])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (len(held) == MEMBERS or size + len(r[3]) > BYTES):
                    yield tile()
                    number, held, size = number + 1, [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield tile()

    def compare(batches):
        for b in batches:
            out = []
            for x in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
                a, *rest = (Tile(r, np.array(c), np.array(o), read(p)) for r, c, o, p in zip(x[::4], x[1::4], x[2::4], x[3::4]))
                out += forest(a, rest[0] if rest else None, same)
            yield edges(out)

    by = ["cluster", "own", "rep"]
    tile = stored(items.select("rep", "cluster", "own", "payload").repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(lambda b: tidy(cut(b)), "tile long, spans array<struct<cluster:long,least:long,most:long>>, reps array<long>, clusters array<long>, owns array<long>, payloads array<binary>"), "tiles")
    span = tile.select("tile", F.inline("spans"))
    pure = span.where("least = most").groupBy("cluster", F.col("least").alias("own")).agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("own", F.struct("n", "own")).alias("main"))
    rest = span.join(pure, "cluster", "left").where("main is null or least < most or least <> main")  # tiles with more than their cluster's main component
    differ = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.tile") != F.col("y.tile")) & ((F.col("x.least") != F.col("y.least")) | (F.col("x.most") != F.col("y.most")) | (F.col("x.least") < F.col("x.most")))
    pair = rest.alias("x").join(span.alias("y"), differ).select(F.least("x.tile", "y.tile").alias("a"), F.greatest("x.tile", "y.tile").alias("b")).distinct()
    side = lambda name: tile.select(F.col("tile").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    joined = pair.join(side("a"), "a").join(side("b"), "b").select(*(f"{x}_{c}" for x in "ab" for c in columns))
    joined = joined.coalesce(max(1, min(partitions(items.sparkSession), tile.count() ** 2)))  # a skewed join may be split into many more
    mixed = tile.where(F.exists("spans", lambda x: x.least < x.most)).select(*columns)
    return mixed.mapInArrow(lambda b: tidy(compare(b)), "u long, v long").union(joined.mapInArrow(lambda b: tidy(compare(b)), "u long, v long"))


def groups(met: DataFrame, payloads: DataFrame, read: Read, same: Same, pivots: int = 1) -> DataFrame:
    """id, component of the members that are linked with another. met: as meeting() gives them; payloads: rep, payload.

    pivots: how often a bucket has one before tiles; more pay where most buckets hold few members that aren't linked.
    """
    met, links = met.withColumn("own", F.col("rep")).withColumn("first", F.col("pivot")), None
    for _ in range(pivots):
        pairs = met.where("rep > pivot and own <> first").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
        found = stored(confirmed(pairs, payloads, read, same, 1 + met.count() // ROWS_A_TASK), "links")
        links = found if links is None else links.union(found)
        labels = stored(components(links), "labels")
        met = stored(unresolved(met, labels), "unresolved")
        if met.isEmpty():
            return labels
    left = met.select("rep", "own", "pivot").distinct()
    cluster = components(left.where("rep > pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v"))).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    items = left.select("rep", "own").distinct().join(cluster, "rep").join(payloads, "rep").select("rep", "cluster", "own", "payload")
    return components(links.union(tiled(items, read, same)))
