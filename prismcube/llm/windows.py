"""Removing windows of k symbols that also start in a document with a smaller id.

The common frame of the two substring operators; a Method says what a symbol is and how a bucket finds equal windows.

1. Sheets. Every scan partition is cut into sheets of whole documents. Consecutive windows that share a minimiser (the
   smallest hash among their m-symbol strings) form a super-k-mer; equal windows always have equal minimisers.
2. Keys. Each sheet sends its distinct minimiser hashes, with their counts, to the part that owns them. A part answers
   with two bits for each: does another document hold it, and is it hot (HOT super-k-mers or more)?
3. Packed strings. A super-k-mer whose minimiser no other document holds can't contain a repeated window and stays.
   The others travel as one packed string to the part of their minimiser, each distinct string once for a sheet, with
   the smallest and largest document. Hot minimisers fall apart: their windows travel one by one to the part of the
   window's own hash, again each distinct one once for a sheet, so no key gathers a share of the corpus in one task.
4. Answers. A part finds the classes of equal windows exactly (Method.classes) and answers each sheet with the runs of
   windows that also start in a smaller document. The sheet applies them to its texts. Equal windows are under one
   minimiser, so a string that is the only one under its own needs no classes.

Hashes only choose parts and candidates; equality is decided on the symbols themselves. Sheets are computed more than
once, so the input must be a scan (a table read from storage), whose partitions are the same each time; a digest of
each sheet goes with its messages, and the job fails if they differ.

Defined results: null text counts as empty; texts of fewer than k symbols keep everything; a null doc_id counts as
larger than all others; rows with the same doc_id don't remove each other's windows; an empty table gives an empty
result; columns besides id and text travel as Arrow (``whole_rows``), so any type and any name comes back as it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from prismcube.llm.common import check_digests, digest, give_back, pack, pack_planes, partitions, spread, tidy, unpack, unpack_planes

#: Text bytes in a sheet, and in a piece of it that is hashed at a time: bound a task's memory.
SHEET_BYTES, PIECE_BYTES = 8 << 20, 1 << 18
#: Ranges of keys that a part finds classes in, one after the other; strings' bytes that classes are found among at a time.
RANGES, CLASS_BYTES = 4, 1 << 18
#: Super-k-mers with one minimiser from which on it is hot.
HOT = 1 << 16
#: Stands for a null doc_id.
LAST = np.iinfo(np.int64).max


class Symbols(NamedTuple):
    """Some documents' symbols, end to end."""

    hashes: np.ndarray  # of every symbol, 64 bits
    ends: np.ndarray  # of every document
    data: bytes  # the symbols themselves
    cuts: np.ndarray  # where in data each symbol starts, and the end


class Method(Protocol):
    k: int
    m: int

    def symbols(self, texts: list[bytes]) -> Symbols: ...

    def cuts(self, texts: list[bytes]) -> tuple[bytes, np.ndarray]:
        """The last two of symbols()."""
        ...

    def size(self, string: bytes) -> int:
        """Symbols in a string."""
        ...

    def classes(self, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window of every string: the string, the window's place in it, the number of its class of equals."""
        ...


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each place on, by doubling; the last n - 1 places have none."""
    done, have, length = None, h, 1
    covered = 0
    while True:
        if n & length:
            if done is None:
                done, covered = have, length
            else:  # done covers the first `covered` symbols; add the next `length`
                tail = have[covered:]
                done = done[: len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail
                covered += length
        if length * 2 > n:
            return mixed(done[: max(0, len(h) - n + 1)])
        tail = have[length:]
        have = have[: len(tail)] * np.uint64(0xD6E8FEB86659FD93 + 2 * length) + tail
        length *= 2


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    have, length = h, 1
    while length * 2 <= w:
        have = np.minimum(have[: len(have) - length], have[length:])
        length *= 2
    rest = w - length
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class Runs(NamedTuple):
    """Super-k-mers: document, first window in the document, how many windows, minimiser's key, first symbol."""

    doc: np.ndarray
    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    at: np.ndarray


def super_kmers(s: Symbols, k: int, m: int) -> Runs:
    none = Runs(*(np.zeros(0, np.int64),) * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(s.hashes) < k:
        return none
    low = sliding_min(gram_hashes(s.hashes, m), k - m + 1)
    starts = np.concatenate([[0], s.ends[:-1]])
    windows = np.maximum(s.ends - starts - k + 1, 0)
    valid = np.zeros(len(low) + 1, np.int8)
    has = windows > 0
    if not has.any():
        return none
    valid[starts[has]] = 1
    valid[starts[has] + windows[has]] -= 1  # the next document starts k - 1 symbols later at the earliest, or is empty
    inside = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[starts[has]] = True
    first = np.flatnonzero(new & inside)
    doc = np.searchsorted(s.ends, first, side="right")
    end = np.minimum(np.append(first[1:], len(low)), starts[doc] + windows[doc])
    key = mixed(low[first]) >> np.uint64(16)
    cut = -(-(end - first) // k)  # in periodic text a run has no end: at most k windows travel as one string
    if (cut > 1).any():
        step = spread(np.zeros(len(cut), np.int64), cut) * k
        first, end, doc, key = (np.repeat(x, cut) for x in (first, end, doc, key))
        first = first + step
        end = np.minimum(end, first + k)
    return Runs(doc, first - starts[doc], end - first, key, first)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Keys have 48 bits; in order of the keys."""
    return ((keys >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def stream_of(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def of_stream(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as reader:
        return reader.read_next_batch()


class Sheet:
    """A sheet as it travels: ids, texts' lengths and bytes, the other columns."""

    schema = "sheet long, digest long, doc_ids array<long>, lengths binary, rest binary, texts binary"

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.ids: list = []
        self.texts: list[bytes] = []
        self.rest: list[pa.Array] | bytes = []

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.number], pa.int64()),
                pa.array([self.digest()], pa.int64()),
                pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([pack(np.array([len(t) for t in self.texts], np.uint32))], pa.binary()),
                pa.array([stream_of(pa.RecordBatch.from_arrays([pa.concat_arrays(self.rest)], names=["rest"]))], pa.binary()),
                pa.array([pack(b"".join(self.texts))], pa.binary()),
            ],
            names=["sheet", "digest", "doc_ids", "lengths", "rest", "texts"],
        )

    def digest(self) -> int:
        """Of ids and texts: tells whether a sheet was cut the same way again."""
        return digest([repr(self.ids).encode(), *self.texts])

    @classmethod
    def of(cls, row) -> Sheet:
        s = cls(row.sheet)
        s.ids, s.rest = list(row.doc_ids), row.rest
        ends, raw = np.cumsum(unpack(row.lengths, np.uint32).astype(np.int64)).tolist(), unpack(row.texts)
        s.texts = [raw[a:b] for a, b in zip([0, *ends], ends)]
        return s

    def order(self) -> np.ndarray:
        return np.array([LAST if i is None or i != i else i for i in self.ids], np.int64)

    def pieces(self) -> Iterator[tuple[int, list[bytes]]]:
        first, held, size = 0, [], 0
        for i, t in enumerate(self.texts):
            held.append(t)
            size += len(t)
            if size >= PIECE_BYTES:
                yield first, held
                first, held, size = i + 1, [], 0
        if held:
            yield first, held


def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[Sheet]:
    """Of a partition's rows (doc_id, text, rest); their cut depends on the rows alone, not on the batches."""
    s = Sheet(TaskContext.get().partitionId() << 24)
    for batch in batches:
        first, rest = 0, batch.column(2)
        for n, (i, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
            t = text.as_buffer().to_pybytes()
            s.ids.append(i)
            s.texts.append(t)
            s.bytes += len(t)
            if s.bytes >= SHEET_BYTES:
                s.rest.append(rest.slice(first, n - first))
                yield s
                s, first = Sheet(s.number + 1), n
        if first < batch.num_rows:
            s.rest.append(rest.slice(first))
    if s.ids:
        yield s


class Keys(NamedTuple):
    """Distinct keys of a sheet in order, how many super-k-mers have each, whether two documents do; the pieces' runs and keys' numbers."""

    key: np.ndarray
    count: np.ndarray
    multi: np.ndarray
    runs: list[Runs]
    numbers: list[np.ndarray]


def sheet_keys(s: Sheet, method: Method) -> Keys:
    runs, firsts = [], []
    for first, texts in s.pieces():
        r = super_kmers(method.symbols(texts), method.k, method.m)
        runs.append(Runs(r.doc.astype(np.int32), r.start.astype(np.int32), r.count.astype(np.int32), r.key, r.at.astype(np.int32)))
        firsts.append(first)
    key = np.concatenate([np.zeros(0, np.uint64), *(r.key for r in runs)])
    doc = np.concatenate([np.zeros(0, np.int32), *(r.doc + np.int32(f) for r, f in zip(runs, firsts))])
    by = np.argsort(key, kind="stable")
    key, doc = key[by], doc[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    last = np.append(at[1:], len(key)) - 1
    number = np.empty(len(key), np.int32)
    number[by] = np.repeat(np.arange(len(at), dtype=np.int32), last[: len(at)] - at + 1)
    cuts = np.cumsum([len(r.key) for r in runs])[:-1]
    return Keys(key[at], last[: len(at)] - at + 1, doc[at] != doc[last[: len(at)]], runs, np.split(number, cuts) if runs else [])


def judge_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two bits for every key of every sheet of a part: another document holds it; it is hot."""
    sheet = [unpack_planes(x, np.uint64) for x in pdf["deltas"]]
    keys = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in sheet])
    counts = np.concatenate([unpack_planes(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
    multi = np.concatenate([unpack_planes(x, np.uint8) for x in pdf["multi"]]).astype(bool)
    own, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    several = times > 1
    several[back[multi]] = True
    hot = np.bincount(back, counts, len(own)) >= HOT
    bits = (several[back] + 2 * (several & hot)[back]).astype(np.uint8)
    cuts = np.cumsum([len(x) for x in sheet])
    return pd.DataFrame({"sheet": pdf["sheet"], "digest": pdf["digest"], "kind": 0, "part": pdf["part"], "answer": [pack(x) for x in np.split(bits, cuts[:-1])]})


class Candidates(NamedTuple):
    """The strings a sheet sends, and where they occur in it."""

    strings: pa.Array  # distinct, by key
    key: np.ndarray
    part: np.ndarray
    low: np.ndarray  # smallest and largest document of each
    high: np.ndarray
    string: np.ndarray  # of every occurrence, its number
    doc: np.ndarray
    start: np.ndarray


def candidates(s: Sheet, answers: pd.DataFrame, method: Method, parts: int) -> Candidates:
    _, _, _, runs, numbers = sheet_keys(s, method)
    rows = answers[answers["kind"] == 0].sort_values("part")
    bits = np.concatenate([unpack(x, np.uint8) for x in rows["answer"]] or [np.zeros(0, np.uint8)])
    strings, key, doc, start = [], [], [], []
    for (first, texts), r, number in zip(s.pieces(), runs, numbers) if bits.any() else ():
        kind = bits[number]
        r = Runs(*(x[kind > 0] for x in r))
        if not len(r.doc):
            continue
        hot = kind[kind > 0] >= 2
        if hot.any():  # single windows, each under its own hash
            n = np.where(hot, r.count, 1).astype(np.int64)
            own = gram_hashes(method.symbols(texts).hashes, method.k) >> np.uint64(16)
            step = spread(np.zeros(len(n), np.int64), n)
            begin, one = np.repeat(r.at, n) + step, np.repeat(hot, n)
            r = Runs(np.repeat(r.doc, n), np.repeat(r.start, n) + step, np.where(one, 1, np.repeat(r.count, n)), np.where(one, own[np.minimum(begin, len(own) - 1)], np.repeat(r.key, n)), begin)
        data, cuts = method.cuts(texts)
        strings.append(pa.array([data[a:b] for a, b in zip(cuts[r.at].tolist(), cuts[r.at + r.count + method.k - 1].tolist())], pa.large_binary()))
        key.append(r.key)
        doc.append(r.doc.astype(np.int64) + first)
        start.append(r.start.astype(np.int64))
    empty = np.zeros(0, np.int64)
    if not strings:
        return Candidates(pa.array([], pa.large_binary()), empty.astype(np.uint64), *(empty,) * 6)
    coded = pa.chunked_array(strings).combine_chunks().dictionary_encode()
    number, key, doc, start = coded.indices.to_numpy().astype(np.int64), *(np.concatenate(x) for x in (key, doc, start))
    n = len(coded.dictionary)
    first = np.empty(n, np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    by = np.argsort(key[first], kind="stable")
    new = np.empty(n, np.int64)
    new[by] = np.arange(n)
    number, ids, key = new[number], s.order()[doc], key[first][by]
    low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, number, ids)
    np.maximum.at(high, number, ids)
    return Candidates(coded.dictionary.take(pa.array(by)), key, part_of(key, parts), low, high, number, doc, start)


def window_classes(strings: list[bytes], key: np.ndarray, method: Method) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Method.classes of distinct strings; one that is alone under its minimiser's key shares its windows with none.

    Equal windows are under one key, so the strings go CLASS_BYTES at a time, by whole keys.
    """
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    alone = times[back] == 1
    several, lone = np.flatnonzero(~alone), np.flatnonzero(alone)
    several = several[np.argsort(back[several], kind="stable")]
    last = np.flatnonzero(np.append(back[several][1:] != back[several][:-1], True)) if len(several) else several  # of each key
    ends = np.cumsum(np.fromiter((len(strings[i]) for i in several), np.int64, len(several)))
    string, place, cls, found, low = [], [], [], 0, 0
    while low < len(several):
        full = np.searchsorted(ends, (ends[low - 1] if low else 0) + CLASS_BYTES)
        high = int(last[np.searchsorted(last, min(full, len(several) - 1))]) + 1
        own = several[low:high]
        x, p, c = method.classes([strings[i] for i in own.tolist()])
        string.append(own[x])
        place.append(p)
        cls.append(c + found)
        found, low = found + (int(c.max()) + 1 if len(c) else 0), high
    have = np.fromiter((method.size(strings[i]) for i in lone), np.int64, len(lone)) - method.k + 1
    more = np.repeat(lone, have)
    step = spread(np.zeros(len(have), np.int64), have)
    return np.concatenate([*string, more]), np.concatenate([*place, step]), np.concatenate([*cls, found + np.repeat(np.arange(len(lone)), have)])


def runs_of(pdf: pd.DataFrame, method: Method, parts: int) -> pd.DataFrame:
    """Answers to every sheet of a part: runs of windows that also start in a smaller document than one of its own.

    Sheets' strings are in order of their keys; they are taken RANGES times, so that windows of a range are held at once.
    """
    lengths = [unpack_planes(x, np.uint32).astype(np.int64) for x in pdf["lengths"]]
    keys = [np.cumsum(unpack_planes(x, np.uint64), dtype=np.uint64) for x in pdf["keys"]]
    low, high = ([unpack_planes(x, np.int64) for x in pdf[c]] for c in ("low", "high"))
    raw = [unpack(x) for x in pdf["strings"]]
    ends = [np.append(0, np.cumsum(x)) for x in lengths]
    cuts = [np.searchsorted(part_of(x, parts * RANGES) - p * RANGES, np.arange(RANGES + 1)) for x, p in zip(keys, pdf["part"])]
    got: list[list[list[np.ndarray]]] = [[] for _ in raw]
    for r in range(RANGES):
        own = [slice(int(c[r]), int(c[r + 1])) for c in cuts]
        taken = lambda of: np.concatenate([x[o] for x, o in zip(of, own)])  # noqa: E731, B023
        size = np.array([o.stop - o.start for o in own])
        if not size.any():
            continue
        data = b"".join(memoryview(x)[int(e[o.start]) : int(e[o.stop])] for x, e, o in zip(raw, ends, own))
        for n, runs in enumerate(range_runs(data, taken(lengths), taken(keys), taken(low), taken(high), size, method)):
            got[n].append([(runs[0] + own[n].start).astype(np.uint32), *runs[1:]])
    none = [np.zeros(0, np.uint32)] * 3 + [np.zeros(0, np.int64)]
    out = [pack(b"".join(pack_with_size(np.concatenate(x)) for x in zip(none, *some))) for some in got]
    return pd.DataFrame({"sheet": pdf["sheet"], "digest": pdf["digest"], "kind": 1, "part": pdf["part"], "answer": out})


def range_runs(raw: bytes, lengths: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, method: Method) -> Iterator[list[np.ndarray]]:
    """For each sheet, which sent ``size`` of the strings: of every run its string's number, its ends, the smallest document."""
    cut = np.append(0, np.cumsum(lengths))
    whole = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode()
    number, n = whole.indices.to_numpy().astype(np.int64), len(whole.dictionary)
    least, key = np.full(n, LAST), np.empty(n, np.uint64)
    np.minimum.at(least, number, low)
    key[number] = keys
    string, place, cls = window_classes(whole.dictionary.to_pylist(), key, method)
    smallest = np.full(int(cls.max()) + 1 if len(cls) else 0, LAST)
    np.minimum.at(smallest, cls, least[string])
    by = np.lexsort((place, string))
    string, smallest = string[by], smallest[cls[by]]
    first = np.searchsorted(string, np.arange(n))
    windows = np.diff(np.append(first, len(string)))
    at = np.concatenate([[0], np.cumsum(size)])
    for a, b in zip(at[:-1], at[1:]):
        own = number[a:b]
        idx = spread(first[own], windows[own])
        row = np.repeat(np.arange(b - a), windows[own])
        least_of = smallest[idx]
        hit = least_of < high[a:b][row]
        new = hit.copy()
        new[1:] &= ~hit[:-1] | (row[1:] != row[:-1]) | (least_of[1:] != least_of[:-1])
        begin = np.flatnonzero(new)
        ends = np.flatnonzero(hit & np.append(~hit[1:] | new[1:], True))
        offset = np.arange(len(idx)) - np.repeat(np.cumsum(windows[own]) - windows[own], windows[own])
        yield [row[begin], offset[begin].astype(np.uint32), (offset[ends] + 1).astype(np.uint32), least_of[begin].astype(np.int64)]


def pack_with_size(x: np.ndarray) -> bytes:
    blob = pack_planes(x) if len(x) else b""
    return len(blob).to_bytes(8, "little") + blob


def unpack_sized(raw: bytes, kinds: list) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(unpack_planes(raw[at + 8 : at + 8 + size], kind) if size else np.zeros(0, kind))
        at += 8 + size
    return out


def removed(s: Sheet, answers: pd.DataFrame, method: Method, parts: int) -> Iterator[np.ndarray]:
    """For every document of a sheet, the runs of removed symbols as rows (first, after the last)."""
    c = candidates(s, answers, method, parts)
    rows = answers[answers["kind"] == 1].sort_values("part")
    sizes = np.bincount(c.part, minlength=parts)
    base = np.cumsum(sizes) - sizes
    got = [unpack_sized(unpack(x), [np.uint32, np.uint32, np.uint32, np.int64]) for x in rows["answer"]]
    string = np.concatenate([x[0].astype(np.int64) + base[p] for x, p in zip(got, rows["part"])] or [np.zeros(0, np.int64)])
    first, after, least = (np.concatenate([x[i].astype(np.int64) for x in got] or [np.zeros(0, np.int64)]) for i in (1, 2, 3))
    by = np.argsort(string, kind="stable")
    string, first, after, least = string[by], first[by], after[by], least[by]
    lo, hi = np.searchsorted(string, c.string), np.searchsorted(string, c.string, side="right")
    occ, run = np.repeat(np.arange(len(lo)), hi - lo), spread(lo, hi - lo)
    hit = least[run] < s.order()[c.doc[occ]]
    occ, run = occ[hit], run[hit]
    doc, begin, end = c.doc[occ], c.start[occ] + first[run], c.start[occ] + after[run] + method.k - 1
    by = np.lexsort((begin, doc))
    doc, begin, end = doc[by], begin[by], end[by]
    at = np.searchsorted(doc, np.arange(len(s.ids) + 1))
    for a, b in zip(at[:-1], at[1:]):
        if a == b:
            yield np.zeros((0, 2), np.int64)
            continue
        reach = np.maximum.accumulate(end[a:b])
        new = np.append(True, begin[a + 1 : b] > reach[:-1])
        yield np.stack([begin[a:b][new], np.append(reach[:-1][new[1:]], reach[-1])], 1)


def remove_repeats(docs: DataFrame, method: Method, apply, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """apply(doc_id, text as bytes, removed runs) gives each document's row under ``schema``."""
    names = StructType.fromDDL(schema).names

    def rows(s: Sheet, removed_runs) -> pd.DataFrame:
        return pd.DataFrame([apply(i, t, x) for i, t, x in zip(s.ids, s.texts, removed_runs)], columns=names).astype({"doc_id": "Int64"})

    return _removed(docs, method, rows, schema, F.lit(None).cast("string"), key, text)


def whole_rows(docs: DataFrame, method: Method, apply, key: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with apply(text as bytes, removed runs) as texts, all columns in place; ``length``, if there, counts its letters.

    A null text stays null.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    rest = F.struct(F.col(f"`{text}`").isNull().alias("no_text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)))

    def rows(s: Sheet, removed_runs) -> pd.DataFrame:
        kept = pa.array([apply(t, x) for t, x in zip(s.texts, removed_runs)], pa.large_string())
        carried = of_stream(s.rest).column(0)
        return pd.DataFrame({"rows": [stream_of(pa.RecordBatch.from_arrays([pa.array(s.ids, pa.int64(), from_pandas=True), kept, carried], names=["doc_id", "text", "rest"]))]})

    def opened(batches):
        for b in batches:
            for blob in b.column(0).to_pylist():
                got = of_stream(blob)
                fields = got.column(2).flatten()
                kept = pc.if_else(fields[0], pa.scalar(None, pa.large_string()), got.column(1))
                own = {c: fields[i + 1] for i, c in enumerate(others)} | {key: got.column(0), text: kept}
                if length in others:
                    own[length] = pc.utf8_length(kept)
                yield pa.RecordBatch.from_arrays([own[c].cast(kinds[c]) if c in kinds else own[c] for c in names], names=names)

    names = docs.columns
    kinds = {c: to_arrow_type(docs.schema[c].dataType) for c in (key, text, length) if c in names}
    return _removed(docs, method, rows, "rows binary", rest, key, text).mapInArrow(lambda b: tidy(opened(b)), docs.schema)


def _removed(docs: DataFrame, method: Method, rows, schema: str, rest, key: str, text: str) -> DataFrame:
    """rows(sheet, every document's removed runs) of every sheet."""
    parts = partitions(docs.sparkSession)
    scan = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8").alias("text"), rest.alias("rest"))

    def send_texts(batches):
        for s in sheets(batches):
            yield s.batch()

    def send_keys(batches):
        for s in sheets(batches):
            keys, counts, multi, _, _ = sheet_keys(s, method)
            part = part_of(keys, parts)
            cut = np.searchsorted(part, np.arange(parts + 1))
            own = [p for p in range(parts) if cut[p] < cut[p + 1]]
            sliced = lambda x: [x[cut[p] : cut[p + 1]] for p in own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int32()),
                    pa.array([s.number] * len(own), pa.int64()),
                    pa.array([s.digest()] * len(own), pa.int64()),
                    pa.array([pack_planes(np.diff(x, prepend=np.uint64(0))) for x in sliced(keys)], pa.binary()),
                    pa.array([pack_planes(x.astype(np.uint32)) for x in sliced(counts)], pa.binary()),
                    pa.array([pack_planes(x.astype(np.uint8)) for x in sliced(multi)], pa.binary()),
                ],
                names=["part", "sheet", "digest", "deltas", "counts", "multi"],
            )

    def send_strings(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            check_digests(row.digest, right["digest"])
            c = candidates(Sheet.of(row), right, method, parts)
            cut = np.searchsorted(c.part, np.arange(parts + 1))
            for p in np.unique(c.part).tolist():
                a, b = int(cut[p]), int(cut[p + 1])
                own = c.strings[a:b].to_pylist()
                out.append((p, row.sheet, row.digest, pack_planes(np.array([len(x) for x in own], np.uint32)), pack(b"".join(own)), pack_planes(np.diff(c.key[a:b], prepend=np.uint64(0))), pack_planes(c.low[a:b]), pack_planes(c.high[a:b])))
        give_back()
        return pd.DataFrame(out, columns=["part", "sheet", "digest", "lengths", "strings", "keys", "low", "high"])

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples(index=False):
            check_digests(row.digest, right["digest"])
            s = Sheet.of(row)
            out.append(rows(s, removed(s, right, method, parts)))
        give_back()
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=StructType.fromDDL(schema).names)

    texts = scan.mapInArrow(lambda b: tidy(send_texts(b)), Sheet.schema)
    keys = scan.mapInArrow(lambda b: tidy(send_keys(b)), "part int, sheet long, digest long, deltas binary, counts binary, multi binary")
    answer = "sheet long, digest long, kind int, part int, answer binary"
    known = keys.groupBy("part").applyInPandas(judge_keys, answer)
    strings = texts.groupBy("sheet").cogroup(known.groupBy("sheet")).applyInPandas(send_strings, "part int, sheet long, digest long, lengths binary, strings binary, keys binary, low binary, high binary")
    found = strings.groupBy("part").applyInPandas(lambda pdf: runs_of(pdf, method, parts), answer)
    return texts.groupBy("sheet").cogroup(known.unionByName(found).groupBy("sheet")).applyInPandas(finish, schema)
