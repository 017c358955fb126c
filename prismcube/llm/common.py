"""Shared plumbing: shared-folder tables, partition counts, packed columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import threading
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismcube.scratch import shared_folder


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, when it is not installed."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors.

    The table is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prismcube-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_quietly_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session is already gone
        pass


def digest(parts: Iterable[bytes]) -> int:
    """63 bits of the parts in order."""
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(p)
    return h.intdigest() >> 1


def check_digests(own: int, others) -> None:
    if any(int(x) != own for x in others):
        raise RuntimeError("a block of the input was not the same when it was read again; write the input to storage first")


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on after a task, beside the executor's other processes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator) -> Iterator:
    """The batches of a task's result; gives memory back after the last."""
    try:
        yield from batches
    finally:
        give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Only the two columns that are needed, whatever else the table holds; null text is empty."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


_held = threading.local()


def _coder(kind: str, make):
    """A thread's own compressor, made once: making one takes longer than a message does."""
    if kind not in vars(_held):
        setattr(_held, kind, make())
    return getattr(_held, kind)


def pack(data: bytes | np.ndarray, level: int = 3) -> bytes:
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).view(np.uint8).data
    return _coder(f"c{level}", lambda: zstandard.ZstdCompressor(level=level)).compress(raw)


def unpack(blob: bytes, dtype=None):
    raw = _coder("d", zstandard.ZstdDecompressor).decompress(blob)
    return raw if dtype is None else np.frombuffer(raw, dtype)


def pack_planes(values: np.ndarray, level: int = 3) -> bytes:
    """Integers byte plane by byte plane, which compresses better than value by value."""
    v = np.ascontiguousarray(values)
    return pack(v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T.copy().reshape(-1), level)


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return unpack(blob, np.uint8).reshape(width, -1).T.copy().reshape(-1).view(dtype)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... counts[i] of them, for every i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
