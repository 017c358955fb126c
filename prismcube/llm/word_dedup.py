"""Substring dedup over words: super-k-mer partitioning.

Remove each word covered by a window of k words that also starts in a document with a smaller id. Consecutive windows
that share a minimiser travel as one packed string to the minimiser's bucket (``windows`` has the frame); there the
windows are sorted and counted exactly: words are numbered, then pairs of equal halves, doubling the length each time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from prismcube.llm import windows
from prismcube.llm.suffix_dedup import runs_as_list
from prismcube.llm.windows import Symbols


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def joined(split: list[list[bytes]]) -> tuple[bytes, np.ndarray]:
    words = [w for s in split for w in s]
    return b" ".join(words) + b" ", np.cumsum(np.fromiter((0, *(len(w) + 1 for w in words)), np.int64, len(words) + 1))


class Words:
    """Symbols are words, runs of anything but ASCII white space; each is followed by one space in the data."""

    def __init__(self, k: int = 50, m: int = 8) -> None:
        self.k, self.m = k, m

    def symbols(self, texts: list[bytes]) -> Symbols:
        split = [t.split() for t in texts]
        ends = np.cumsum(np.array([len(w) for w in split], np.int64))
        words = pa.array([w for s in split for w in s], pa.large_binary())
        coded = words.dictionary_encode()
        own = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = own[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.uint64)
        return Symbols(hashes, ends, *joined(split))

    def cuts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        return joined([t.split() for t in texts])

    def size(self, string: bytes) -> int:
        return string.count(b" ")

    def classes(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        split = [s.split() for s in strings]
        counts = np.array([len(w) for w in split], np.int64)
        rank = pa.array([w for s in split for w in s], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        length = 1
        while length * 2 <= self.k:
            rank = pairs(rank[:-length], rank[length:])
            length *= 2
        if length < self.k:
            rest = self.k - length
            rank = pairs(rank[:-rest], rank[rest:])
        starts = np.cumsum(counts) - counts
        have = np.maximum(counts - self.k + 1, 0)
        string = np.repeat(np.arange(len(strings)), have)
        place = windows.spread(np.zeros(len(strings), np.int64), have)
        return string, place, rank[starts[string] + place]


def kept_words(data: bytes, runs: np.ndarray) -> tuple[int, list[bytes]]:
    words = data.split()
    edges = [0, *runs.reshape(-1).tolist(), len(words)]
    return len(words), [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]


def repeated_words(docs: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (first, after the last of every removed run of words), kept (the others, joined by a space)."""

    def row(doc, data, runs):
        n, kept = kept_words(data, runs)
        return doc, n, runs_as_list(runs), b" ".join(kept).decode()

    return windows.remove_repeats(docs, Words(k), row, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string", key, text)


def repeated_words_digest(docs: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def row(doc, data, runs):
        n, kept = kept_words(data, runs)
        return doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return windows.remove_repeats(docs, Words(k), row, "doc_id long, n_words long, n_removed long, kept_sha256 string", key, text)
