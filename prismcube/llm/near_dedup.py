"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct 5-word shingles. A sketch holds M registers; each is the smallest of the set's hashes
under its own function, read as an exponential variable, on an exponential scale (powers of BASE) cut off at both ends,
so the sketch of a union is the larger register of both, and the share of equal registers follows the similarity.

1. Sets that are equal are one representative, by a 128-bit digest.
2. Bands of ROWS registers send representatives to buckets. A pair at the threshold 0.75 shares no band with
   probability (1 - 0.75**4)**40 = 2e-7.
3. Members of a bucket are compared with its pivot, and what is left in tiles (``rounds``): every two that share a band are
   compared or in one component already, and no output grows with the square of a bucket.
4. A comparison takes the joint maximum-likelihood estimate of the similarity from both sketches; pairs under CUT (five
   standard errors under the threshold) go. The others are confirmed on the full sets.

A shingle counts by 64 bits of hash in these sets; two shingles of a pair of documents agree by chance with probability
5e-14 for a thousand shingles each.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; with fewer words than a
shingle the whole sequence is one; repeated rows are equal sets; a null doc_id names no component and is kept; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.llm import rounds
from prismcube.llm.common import documents, stored, tidy
from prismcube.llm.windows import gram_hashes

SHINGLE, BANDS, ROWS = 5, 40, 4
M = BANDS * ROWS
#: SetSketch's base, rate and largest register.
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2
#: Estimated similarity, and share of equal registers before that, from which on a pair is confirmed on the full sets.
CUT, EQUAL = 0.55, 0.4
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Text bytes sketched at a time.
PIECE_BYTES = 1 << 19

FACTORS = np.random.default_rng(3).integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1)


class Sketch(NamedTuple):
    shingles: np.ndarray  # distinct, in order
    registers: np.ndarray


def registers(shingles: np.ndarray) -> np.ndarray:
    low = np.full(M, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        low = np.minimum(low, (short[at : at + 512, None] * FACTORS).min(0))
    smallest = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def sketches(texts: list[str]) -> Iterator[Sketch]:
    """Of every text; its words are split by ASCII white space, A-Z lower-cased."""
    split = [t.encode().lower().split() for t in texts]
    coded = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    words = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
    at = 0
    for s in split:
        mine = words[at : at + len(s)]
        at += len(s)
        shingles = np.unique(gram_hashes(mine, min(SHINGLE, len(s)))) if len(s) else np.zeros(0, np.uint64)
        yield Sketch(shingles, registers(shingles))


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        first, size = 0, 0
        column = b.column(text)
        for i, t in enumerate(column):
            size += len(t.as_buffer()) if t.is_valid else 0
            if size >= PIECE_BYTES or i + 1 == len(column):
                yield b.slice(first, i + 1 - first), column.slice(first, i + 1 - first).to_pylist()
                first, size = i + 1, 0


def estimate(n: np.ndarray, m: np.ndarray, more: np.ndarray, less: np.ndarray, steps: int = 128) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets of n and m elements, of whose registers so many differ each way."""
    u, v = n / (n + m), m / (n + m)
    top = np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, out = np.full(len(n), -np.inf), np.zeros(len(n))
    same = M - more - less
    for step in range(1, steps + 1):
        j = top * step / steps
        a, b = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        value = more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))
        better = value > best
        best, out = np.where(better, value, best), np.where(better, j, out)
    return out


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """100 * |a and b| >= least * |a or b|, of sets in order."""
    if len(a) > len(b):
        a, b = b, a
    both = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
    return 100 * both >= least * (len(a) + len(b) - both)


def likely(n: np.ndarray, m: np.ndarray, more: np.ndarray, less: np.ndarray, cut: float = CUT) -> np.ndarray:
    """Is estimate() ``cut`` or more? The likelihood has one maximum; it lies above cut where it still rises there."""
    u, v = n / (n + m), m / (n + m)
    x, y = u - v * cut, v - u * cut
    able = (x > 0) & (y > 0)  # else even the smaller set's whole share is under cut
    x, y = np.where(able, x, 0.5), np.where(able, y, 0.5)
    share = (BASE - 1) / BASE
    p = lambda z: -np.log1p(-z * share) / np.log(BASE)
    slope = lambda z: share / ((1 - z * share) * np.log(BASE))
    rising = -v * more * slope(x) / p(x) - u * less * slope(y) / p(y) + (M - more - less) * (v * slope(x) + u * slope(y)) / (1 - p(x) - p(y))
    return able & (rising >= 0)


class Sketches(NamedTuple):
    """Of several documents, as payloads give them."""

    shingles: list[np.ndarray]
    sizes: np.ndarray
    registers: np.ndarray


def read(payloads: list[bytes]) -> Sketches:
    shingles = [np.frombuffer(p, np.uint64, offset=2 * M) for p in payloads]
    return Sketches(shingles, np.array([len(x) for x in shingles], float), np.stack([np.frombuffer(p, "<u2", M) for p in payloads]))


def same(some: Sketches, i: int, others: Sketches, js: np.ndarray, least: int) -> np.ndarray:
    """Which of others (at js) are linked with i of some: by size and registers first, then on the full sets."""
    n, m, mine = some.sizes[i], others.sizes[js], some.registers[i]
    able = np.flatnonzero(100 * np.minimum(n, m) >= least * np.maximum(n, m))
    able = able[(others.registers[js[able]] == mine).sum(1) >= EQUAL * M]
    theirs = others.registers[js[able]]
    able = able[likely(np.full(len(able), n), m[able], (mine > theirs).sum(1), (mine < theirs).sum(1))]
    hit = np.zeros(len(js), bool)
    hit[able] = [linked(some.shingles[i], others.shingles[j], least) for j in js[able].tolist()]
    return hit


def near_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; linked from ``percent`` of the union on (75 or more)."""
    if percent < 75:
        raise ValueError("the bands are set for similarities of 75 percent or more")
    spark = docs.sparkSession
    rows = documents(docs, text, key)

    def sketch(batches):
        for b, texts in pieces(batches, 1):
            s = list(sketches(texts))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.shingles) for x in s], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.shingles.tobytes()) for x in s], pa.binary()), pa.array([x.registers.tobytes() for x in s], pa.binary())],
                names=["doc_id", "n", "digest", "registers"],
            )

    def with_sets(batches):
        for b, texts in pieces(batches, 1):
            s = list(sketches(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.registers.tobytes() + x.shingles.tobytes() for x in s], pa.binary())], names=["rep", "payload"])

    sketched = stored(rows.mapInArrow(lambda b: tidy(sketch(b)), "doc_id long, n long, digest binary, registers binary"), "sketches")
    first = stored(sketched.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "first")
    ids = F.broadcast(first.select("rep")) if first.count() <= BROADCAST_IDS else first.select("rep")
    reps = sketched.where("n > 0").withColumnRenamed("doc_id", "rep").join(ids, "rep", "left_semi")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    buckets = stored(rounds.meeting(reps.select("rep", band.alias("band", "bucket")).select("rep", "bucket")), "buckets")
    members = buckets.select("rep")
    wanted = F.broadcast(members) if buckets.count() <= BROADCAST_IDS else members.distinct()
    sets = rows.join(wanted, rows.doc_id == members.rep, "left_semi").select(F.col("doc_id").alias("rep"), "text").mapInArrow(lambda b: tidy(with_sets(b)), "rep long, payload binary")
    reach = rounds.groups(buckets, stored(sets, "sets"), read, lambda a, i, b, js: same(a, i, b, js, percent)).withColumnRenamed("id", "rep")
    known = first.join(reach, "rep", "left")
    known = known.where("copies > 1 or component is not null").select("digest", F.coalesce("component", "rep").alias("component"))
    known = stored(known, "known")  # so that the join on a digest that many rows have can be split
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(known, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, percent: int = 75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that near_duplicates() doesn't keep."""
    gone = stored(near_duplicates(docs, percent, key, text).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    ids = (F.broadcast(gone) if few else gone).alias("ids")
    return docs.alias("docs").join(ids, F.col(f"docs.`{key}`").cast("long") == F.col("ids.gone"), "left_anti")
