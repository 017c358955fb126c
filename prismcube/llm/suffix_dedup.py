"""Suffix-array dedup: repeated byte strings found by column-wise construction of a collection's BWT.

Remove each byte covered by a k-byte string that also starts in a document with a smaller id (``windows`` has the frame:
sheets, candidate strings, answers). In a part, ``Columns`` builds the Burrows-Wheeler transform and the longest common
prefixes of all its strings at once: each round puts one more symbol of every string, from the right, in front of the
suffix that the string already has in the collection. The columns (symbol, common prefix, string, length) are streams
that every round reads and writes once in order; a part's size is bounded, so they are kept in memory, not in files
that would be lost with the machine. Suffixes whose common prefixes reach k are the same k bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from prismcube.llm import windows
from prismcube.llm.windows import Symbols

#: No byte of UTF-8; ends every string.
END = 0xFF


def range_min(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(lcp[low + 1 .. high]) for low < high."""
    zeros = np.cumsum(lcp == 0, dtype=np.int32)
    out = np.zeros(len(low), lcp.dtype)
    ask = np.flatnonzero(zeros[high] == zeros[low])
    if not len(ask):
        return out
    low, high = low[ask] + 1, high[ask]
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    table = lcp
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[ask[at]] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        step = 1 << k
        if len(table) > step:
            table = np.minimum(table[:-step], table[step:])
    return out


class Columns:
    """The collection after each round; rows are suffixes in order, those of no symbols (one a string) left out.

    A symbol stands for the row that it starts: sorting the symbols of all rows by themselves, ties in order, gives the
    rows of the longer suffixes in order, and so where the new ones go.
    """

    def __init__(self, strings: list[bytes], k: int) -> None:
        self.k, self.n = k, len(strings)
        self.lengths = np.array([len(s) for s in strings], np.int32)
        self.data, self.ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum(self.lengths, dtype=np.int64)
        some = self.lengths > 0
        self.first = np.full(self.n, END, np.uint8)  # symbols of the rows of no symbols
        self.first[some] = self.data[self.ends[some] - 1]
        small = self.lengths.max(initial=0) < 256
        number = "u1" if small else "<u2"
        kind = [("string", "<u4"), ("length", number), ("lcp", number), ("symbol", "u1"), ("fresh", "?")]
        #: symbol: the one before the suffix; fresh: it starts a suffix that is not in the collection yet.
        self.rows = np.zeros(0, np.dtype(kind if small else [*kind, ("", "V6")]))
        self.whole = np.dtype("<u8" if small else "<c16")  # a row, to be moved as one value

    def insert(self, size: int) -> None:
        """One round: the suffixes of ``size`` symbols, of all strings that are as long."""
        symbols = np.concatenate([self.first, self.rows["symbol"]])
        order = np.argsort(symbols, kind="stable")
        order = order[: len(order) - int(np.count_nonzero(symbols == END))]
        new = np.concatenate([np.full(self.n, size == 1), self.rows["fresh"]])[order]
        at = np.flatnonzero(new)
        before = order[at]
        own = before if size == 1 else self.rows["string"][before - self.n]
        rows = np.empty(len(order), self.rows.dtype)
        rows.view(self.whole)[~new] = self.rows.view(self.whole)
        rows["fresh"] = False
        ask = new.copy()
        ask[1:] |= new[:-1]
        ask = np.flatnonzero(ask)
        lcp = np.zeros(len(ask), rows.dtype["lcp"])
        place = np.flatnonzero((ask > 0) & (symbols[order[ask]] == symbols[order[ask - 1]]))
        if len(place):
            shorter = np.concatenate([np.zeros(self.n, rows.dtype["lcp"]), self.rows["lcp"]])
            lcp[place] = np.minimum(range_min(shorter, order[ask[place] - 1], order[ask[place]]), self.k - 1) + 1
        longer = self.lengths[own] > size
        ahead = np.full(len(own), END, np.uint8)
        ahead[longer] = self.data[self.ends[own[longer]] - size - 1]
        added = np.zeros(len(own), rows.dtype)
        added["string"], added["length"], added["symbol"], added["fresh"] = own, size, ahead, longer
        rows[at] = added
        rows["lcp"][ask] = lcp
        self.rows = rows

    def build(self) -> Columns:
        for size in range(1, int(self.lengths.max(initial=0)) + 1):
            self.insert(size)
        return self


class Bytes:
    """Symbols are bytes; windows are told apart by the collection's order."""

    def __init__(self, k: int = 50, m: int = 24) -> None:
        self.k, self.m = k, m
        self.hash = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64, endpoint=False)

    def symbols(self, texts: list[bytes]) -> Symbols:
        data, cuts = self.cuts(texts)
        return Symbols(self.hash[np.frombuffer(data, np.uint8)], np.cumsum(np.array([len(t) for t in texts], np.int64)), data, cuts)

    def cuts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        data = b"".join(texts)
        return data, np.arange(len(data) + 1)

    def size(self, string: bytes) -> int:
        return len(string)

    def classes(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = Columns(strings, self.k).build()
        whole = c.rows["length"] >= self.k
        cls = np.cumsum(c.rows["lcp"] < self.k)[whole]
        string = c.rows["string"][whole].astype(np.int64)
        return string, c.lengths[string] - c.rows["length"][whole].astype(np.int64), np.unique(cls, return_inverse=True)[1]


def runs_as_list(runs: np.ndarray) -> list[dict]:
    return [{"start": int(a), "end": int(b)} for a, b in runs]


def without(data: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return data
    edges = [0, *runs.reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeated_bytes(docs: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start, end of every removed run), kept (bytes that are left)."""

    def row(doc, data, runs):
        return doc, len(data), runs_as_list(runs), without(data, runs)

    return windows.remove_repeats(docs, Bytes(k), row, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary", key, text)


def repeated_bytes_digest(docs: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def row(doc, data, runs):
        return doc, len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(without(data, runs)).hexdigest()

    return windows.remove_repeats(docs, Bytes(k), row, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", key, text)


def without_repeats(docs: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with the repeated bytes taken out of their texts, all columns in place; ``length``, if there, is counted anew.

    Bytes of a character that was cut apart go with its removed part.
    """
    return windows.whole_rows(docs, Bytes(k), lambda data, runs: without(data, runs).decode("utf-8", "ignore"), key, text, length)
