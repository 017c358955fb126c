"""Packing documents into fixed-length sequences along a space-filling curve.

Each document's hashed vector (the frequencies of its tokens, each hashed to a bucket) is projected by a fixed random
matrix to DIMS coordinates and their cell gets a Hilbert number. Documents are range-sorted by that number, so neighbours on the
curve share words, and every range is packed on its own: its documents are laid end to end and cut at every ``length``
ids. What remains at the end of a range is cut at powers of two, largest first, so no sequence needs padding. Nothing
is gathered on the driver, and ties on the curve (copies, repeated rows) are split by the row's place in the input, so a
group of copies of any size spreads over ranges.

Defined results: null text counts as empty; an empty document is its end id alone; repeated rows are packed each on
its own; a null doc_id is kept as null; an empty table gives an empty result; other columns are ignored; documents of
more than CHUNK_IDS ids travel as several rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from prismcube.llm.common import documents, pack_planes, partitions, stored, tidy, unpack_planes

DIMS, BITS = 4, 10
#: Buckets of the hashed document vector, and the factor that spreads its projections over the cells.
BUCKETS, SPREAD = 1 << 16, 16.0
#: Ids in a row of the shuffle, at most.
CHUNK_IDS = 1 << 16
#: Text bytes tokenised at a time.
PIECE_BYTES = 1 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert numbers of cells (rows of non-negative integers under 2**bits), by Skilling's transposition."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hilbert numbers of documents (ends: where each ends in ids): token frequencies, hashed to buckets, projected."""
    plane = np.random.default_rng(7).choice(np.array([-1.0, 1.0], np.float32), (BUCKETS, DIMS))
    sums = np.add.reduceat(plane[ids & (BUCKETS - 1)], np.append(0, ends[:-1]), axis=0, dtype=np.float64)
    at = SPREAD * sums / np.diff(ends, prepend=0)[:, None]
    return hilbert(np.minimum((2**BITS / (1 + np.exp(-at))).astype(np.int64), 2**BITS - 1), BITS)


class Encoder:
    """Ids of a byte-level BPE vocabulary file; the strings of special tokens are ordinary text, or, with ``added``, give
    the ids that the file has for them, as its library does by itself.

    Where the file's merges are in the order of their ids (as a rank file has them), the rank encoder runs, which gives
    the same ids in a third of the time; else, for a text that it refuses, and with ``added`` for a text that holds an
    added token's string, the file's own library.
    """

    def __init__(self, data: str, pattern: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(data)
        self.whole.encode_special_tokens = not added
        model = json.loads(data)["model"]
        byte_of = {letter: b for b, letter in byte_letters().items()}
        special = {t["content"] for t in json.loads(data).get("added_tokens", ())}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbers = [model["vocab"].get("".join(m), -1) for m in merges]
        self.added = sorted(special) if added else []
        self.ranked = None
        if numbers == sorted(set(numbers)) and len(numbers) + 256 == len(ranks):
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is not None and not any(x in text for x in self.added):
            try:
                return np.array(self.ranked.encode_ordinary(text), np.uint32)
            except ValueError:  # its pattern matcher's limits
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def powers(n: int) -> list[int]:
    """The powers of two that make up n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, length: int = 2048, added: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see the module's text."""
    spark = docs.sparkSession
    with open(tokenizer_path) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size is fixed

    def tokenised(batches):
        row = TaskContext.get().partitionId() << 40  # of the first row; no two rows have the same
        encode = Encoder(vocabulary.value, pattern, added)
        for b in batches:
            first, size, column = 0, 0, b.column(1)
            for i, t in enumerate(column):
                size += len(t.as_buffer())
                if size < PIECE_BYTES and i + 1 < len(column):
                    continue
                docs = [np.append(encode(x.as_py()), np.uint32(end_id)) for x in column.slice(first, i + 1 - first)]
                keys = curve_keys(np.concatenate(docs), np.cumsum([len(x) for x in docs]))
                names = b.column(0).slice(first, i + 1 - first).to_pylist()
                rows = [(key, row + n, doc, s, len(ids), pack_planes(ids[s : s + CHUNK_IDS], 1)) for n, (key, doc, ids) in enumerate(zip(keys.tolist(), names, docs)) for s in range(0, len(ids), CHUNK_IDS)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*(pa.int64(),) * 5, pa.binary()))], names=["key", "row", "doc_id", "start", "doc_tokens", "ids"])
                first, size, row = i + 1, 0, row + len(docs)

    def packed(batches):
        first, place = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []  # the last sequence so far: (doc_id, start, doc_tokens, ids)

        def pieces(of: list[tuple], sequence: int) -> list[tuple]:
            out, offset = [], 0
            for doc, start, total, ids in of:
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))
                offset += len(ids)
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        sequence = first
        for batch in batches:
            out = []
            for doc, start, total, blob in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                ids, at = unpack_planes(blob, np.uint32), 0
                while at < len(ids):
                    own = ids[at : at + length - place]
                    held.append((doc, start + at, total, own))
                    at += len(own)
                    place += len(own)
                    if place == length:
                        out += pieces(held, sequence)
                        held, place, sequence = [], 0, sequence + 1
            if out:
                yield batch_of(out)
        out = []
        for size in powers(place):
            own, place = [], 0
            while place < size:
                doc, start, total, ids = held.pop(0)
                own.append((doc, start, total, ids[: size - place]))
                if len(ids) > size - place:
                    held.insert(0, (doc, start + size - place, total, ids[size - place :]))
                place += len(own[-1][3])
            out += pieces(own, sequence)
            sequence += 1
        if out:
            yield batch_of(out)

    rows = documents(docs).mapInArrow(lambda b: tidy(tokenised(b)), "key long, row long, doc_id long, start long, doc_tokens long, ids binary")
    by_curve = ["key", "row", "start"]
    ordered = stored(rows, "tokens").repartitionByRange(partitions(spark), *by_curve).sortWithinPartitions(*by_curve)
    return ordered.mapInArrow(lambda b: tidy(packed(b)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
