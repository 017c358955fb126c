"""Connected components: in one task where the edges are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from prismcube.llm.common import stored


#: Edges that one task may hold (16 bytes each); more go by rounds.
FEW = 1 << 20


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one that the edges (i, j) reach."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def at_once(batches):
    """components() of all edges in one task."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if pairs:
        u, v = (np.concatenate(x) for x in zip(*pairs))
        ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = ids[roots(len(ids), place[: len(u)], place[len(u) :])]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(root)], names=["id", "component"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """id, component (smallest id reachable) of every vertex of edges (u, v); loops and repeated edges are allowed.

    Up to ``few`` edges, counted first, are joined in one task. Else each round hangs every vertex's larger neighbours,
    then its smaller ones, below the smallest; it ends when a round changes nothing, after about log(diameter) rounds. A
    round is written to the shared folder. A vertex with a share of all edges is reduced by a partial minimum and joined
    by a skew-splitting join.
    """
    edge = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    known = None
    while True:
        seen = Observation()
        counted = edge.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum"))
        edge = stored(counted, "edges")
        now = (seen.get["n"], seen.get["sum"])
        if known is None and now[0] <= few:
            return edge.coalesce(1).mapInArrow(at_once, "id long, component long")
        if now == known:
            break
        edge, known = (edge.distinct() if known is None else edge), now
        both = edge.union(edge.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = small.union(low).distinct()
    return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edge.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
