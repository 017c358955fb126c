"""Embedding near-dedup: PCA-ordered tiled comparison.

Equal vectors of a label (by a 128-bit digest) are one representative with a multiplicity. Unit representatives fall into
cells of CELL leading principal coordinates, as wide as two linked ones can differ in one; they are ordered by label, cell and
leading coordinate and cut into tiles, and tiles of neighbouring cells meet by an equi-join. Pairs of tiles whose boxes
of leading coordinates are too far apart are skipped; the others are compared block of coordinates by block, leading ones
first: a pair is dropped as soon as its product so far plus the product of the two suffix norms can't reach the
threshold. What is left is decided by its cosine in double precision on the vectors as given, up to a power of two that
keeps squares in range. A tile pair gives link counts and a local forest, never its links, so a group of near copies
costs a row for each vector and tile pair.

The basis comes from at most SAMPLE representatives; it only orders and bounds, any rotation gives the same result.

Defined results: a null label, a null, empty or zero vector and one with null or non-finite components link with
nothing; vectors of different lengths don't link; repeated rows are vectors of their own (equal ones are linked); a
null vec_id is kept and names no component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.llm.common import partitions, stored
from prismcube.llm.components import components, roots

#: Vectors in a tile; coordinates compared at a time; leading coordinates of a cell and in a tile's box; vectors that give the basis.
TILE, BLOCK, CELL, BOX, SAMPLE = 512, 16, 2, 8, 4096
#: Room for rounding in bounds.
EPS = 1e-6


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For every length of vectors, principal directions as columns, largest variance first."""
    sample = vectors.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").collect()
    by_length: dict[int, list] = {}
    for (v,) in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for n, rows in by_length.items():
        x = unit(np.array(rows, np.float64))
        out[n] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two, which is exact, so that the largest component is between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine is least or more."""
    p, q = unit(a) @ basis, unit(b) @ basis
    dims = p.shape[1]
    cuts = [*range(0, dims, BLOCK), dims]
    tail = lambda x, at: np.sqrt(np.maximum((x[:, at:] ** 2).sum(1), 0))
    first = cuts[1]
    have = p[:, :first] @ q[:, :first].T
    i, j = np.nonzero(have + np.outer(tail(p, first), tail(q, first)) >= least - EPS)
    have = have[i, j]
    for low, high in zip(cuts[1:-1], cuts[2:]):
        have = have + np.einsum("ij,ij->i", p[i, low:high], q[j, low:high])
        open_ = have + tail(p, high)[i] * tail(q, high)[j] >= least - EPS
        i, j, have = i[open_], j[open_], have[open_]
    a, b = scaled(a), scaled(b)
    cosine = np.einsum("ij,ij->i", a[i], b[j]) / (np.linalg.norm(a, axis=1)[i] * np.linalg.norm(b, axis=1)[j])
    return i[cosine >= least], j[cosine >= least]


def near_duplicates(vectors: DataFrame, least: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; see the module's text."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", fine) & F.exists("vec", lambda x: x != 0)
    digest = [F.when(usable, F.xxhash64(F.lit(k), "vec")).alias(f"digest{k}") for k in (1, 2)]  # null where not usable
    reps = stored(rows.where(usable).groupBy("label", *digest).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec")).where(F.col("rep").isNotNull()), "vectors")
    basis = spark.sparkContext.broadcast(bases(reps))  # at most SAMPLE vectors' lengths, a square matrix each
    whole = lambda n: basis.value.get(n, np.eye(n))

    width = float(np.sqrt(2 - 2 * least + EPS))

    def ordered(batches):
        for b in batches:
            at = b.column(1).offsets.to_numpy()
            flat, dims = b.column(1).values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(at)
            lead = np.zeros((b.num_rows, CELL))
            for n in np.unique(dims).tolist():
                own = np.flatnonzero(dims == n)
                p = unit(flat[at[own][:, None] + np.arange(n)]) @ whole(n)[:, :CELL]
                lead[own, : p.shape[1]] = p
            cells = np.floor(lead / width).astype(np.int64)
            vec = [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(cells.tolist(), pa.list_(pa.int64())), pa.array(lead[:, 0]), b.column(2), b.column(3), pa.array(vec, pa.binary())], names=["label", "dims", "cell", "lead", "rep", "n", "vec"])

    def tiles(batches):
        number, held, group = TaskContext.get().partitionId() << 24, [], None

        def tile():
            x = np.array([np.frombuffer(r[6]) for r in held])
            lead = (unit(x) @ whole(x.shape[1]))[:, :BOX]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([held[0][0]], label_type), pa.array([held[0][1]], pa.int32()), pa.array([held[0][2]], pa.list_(pa.int64())),
                    pa.array([lead.min(0).tolist()], pa.list_(pa.float64())), pa.array([lead.max(0).tolist()], pa.list_(pa.float64())),
                    pa.array([[r[4] for r in held]], pa.list_(pa.int64())), pa.array([[r[5] for r in held]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                ],
                names=["tile", "label", "dims", "cell", "low", "high", "reps", "counts", "data"],
            )

        label_type = None
        for b in batches:
            label_type = b.schema.field(0).type
            for r in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if held and (len(held) == TILE or r[:3] != group):
                    yield tile()
                    number, held = number + 1, []
                group = r[:3]
                held.append(r)
        if held:
            yield tile()

    def compare(batches):
        for b in batches:
            got: list[tuple] = []
            for same, dims, ra, ca, da, rb, cb, db in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                x, y = (np.frombuffer(d).reshape(-1, dims) for d in (da, db))
                i, j = links(x, y, whole(dims), least)
                ca, cb = np.array(ca), np.array(cb)
                ids = np.array(ra if same else ra + rb)
                if same:
                    i, j = i[i != j], j[i != j]
                    total = np.bincount(i, ca[j], len(ids))
                else:
                    j = j + len(ca)
                    counts = np.concatenate([ca, cb])
                    total = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
                by = np.argsort(ids, kind="stable")  # so that the smallest place is the smallest id
                place = np.empty(len(ids), np.int64)
                place[by] = np.arange(len(ids))
                root = ids[by][roots(len(ids), place[i], place[j])][place]
                got += [(int(ids[k]), int(root[k]), int(total[k])) for k in np.flatnonzero(total)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["u", "v", "links"])

    label_kind = dict(rows.dtypes)["label"]
    count = reps.count()
    n = max(1, min(partitions(spark), -(-count // TILE)))
    by = ["label", "dims", "cell", "lead", "rep"]
    lead = reps.select("label", "vec", "rep", "n").mapInArrow(ordered, f"label {label_kind}, dims int, cell array<long>, lead double, rep long, n long, vec binary")
    tile = stored(lead.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(tiles, f"tile long, label {label_kind}, dims int, cell array<long>, low array<double>, high array<double>, reps array<long>, counts array<long>, data binary"), "tiles")
    box = tile.select("tile", "label", "dims", "cell", "low", "high")
    steps = [F.array(*(F.col("cell")[k] + x for k, x in enumerate(step))) for step in product((-1, 0, 1), repeat=CELL)]
    around = box.withColumn("cell", F.explode(F.array(*steps)))
    gap = F.aggregate(F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dims", "cell")]
    pair = box.alias("a").join(around.alias("b"), reduce(and_, same) & (F.col("a.tile") <= F.col("b.tile")) & (gap <= 2 - 2 * least + EPS)).select(F.col("a.tile").alias("first"), F.col("b.tile").alias("second"))
    side = lambda name: tile.select(F.col("tile").alias(name), F.col("reps").alias(f"{name}_reps"), F.col("counts").alias(f"{name}_counts"), F.col("data").alias(f"{name}_data"), F.col("dims").alias(f"{name}_dims"))
    joined = pair.repartition("first", "second").join(side("first"), "first").join(side("second"), "second")
    found = stored(joined.select(F.col("first") == F.col("second"), "first_dims", "first_reps", "first_counts", "first_data", "second_reps", "second_counts", "second_data").mapInArrow(compare, "u long, v long, links long"), "links")
    own = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "rep")
    reach = components(found.select("u", "v")).withColumnRenamed("id", "rep")
    known = reps.select("label", "digest1", "digest2", "rep", "n").join(own, "rep", "left").join(reach, "rep", "left").where("n > 1 or links is not null")
    known = stored(known.select("label", "digest1", "digest2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "known")
    out = rows.select("vec_id", "label", *digest).join(known, ["label", "digest1", "digest2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
