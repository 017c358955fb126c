"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Every scan partition is cut into blocks of whole documents. A block explodes its texts into pre-tokens with their
positions (an array of word numbers) and its distinct words. The distinct words travel to a part chosen by the word's
hash; there each is encoded once, whatever the number of blocks that hold it. The ids travel back to the block, where
the word numbers put them in place. A word that fills a third of the corpus is one entry per block.

Blocks are computed twice, once for the words and once for the positions, so the input must be a scan (a table read
from storage), whose partitions are the same each time; a digest of each block goes with its messages, and the job
fails if they differ.

Defined results: null text counts as empty; an empty text has 0 tokens and the digest of no bytes; repeated rows give
repeated results; a null doc_id is kept as null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismcube.llm.common import check_digests, digest, documents, give_back, pack, pack_planes, partitions, spread, tidy, unpack, unpack_planes

#: Text bytes in a block: bounds a task's memory.
BLOCK_BYTES = 32 << 20
#: Text bytes tokenised at a time.
CHUNK_BYTES = 2 << 20
#: Parts of the word exchange for each shuffle partition.
PARTS = 4


class Block:
    """Documents, their word numbers in order of position, and the distinct words in order of first use."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.ids: list = []
        self.counts: list[int] = []
        self.codes: list[np.ndarray] = []
        self.words: dict[str, int] = {}

    def digest(self) -> int:
        """Tells whether a block was cut the same way again."""
        return digest([repr(self.ids).encode(), *(c.tobytes() for c in self.codes), "\0".join(self.words).encode()])

    def add(self, ids: list, tokens: list[list[str]]) -> None:
        flat = pa.array([w for t in tokens for w in t], pa.large_string()).dictionary_encode()
        own = np.array([self.words.setdefault(w, len(self.words)) for w in flat.dictionary.to_pylist()], np.int32)
        self.codes.append(own[flat.indices.to_numpy()] if len(own) else np.zeros(0, np.int32))
        self.ids += ids
        self.counts += map(len, tokens)

    def by_part(self, parts: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Word numbers made contiguous by part: the words in that order, the part of each, old number -> new."""
        words = [w.encode() for w in self.words]
        part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int32, len(words))
        order = np.argsort(part, kind="stable")
        new = np.empty(len(words), np.int32)
        new[order] = np.arange(len(words), dtype=np.int32)
        return part[order], [words[i] for i in order], new


#: Texts of code points below this are split by the standard library's matcher, others by the full one.
PLAIN = 0x250


class Splitter:
    """Pre-tokens of texts. For plain texts the pattern's letter, number and space classes are spelled out as ranges."""

    def __init__(self, pattern: str) -> None:
        self.whole = regex.compile(pattern).findall
        own = {kind: self.ranges(kind) for kind in (r"\p{L}", r"\p{N}", r"\s")}
        out, at, inside = [], 0, False
        while at < len(pattern):
            kind = next((k for k in (*own, r"\S") if pattern.startswith(k, at)), pattern[at])
            if kind == r"\S":
                out.append(f"[^{own[chr(92) + 's']}]" if not inside else kind)
            elif kind in own:
                out.append(own[kind] if inside else f"[{own[kind]}]")
            else:
                inside = kind == "[" or inside and kind != "]"
                out.append(kind)
            at += len(kind)
        plain = "".join(out)
        self.plain = None if "\\p" in plain or r"\S" in plain else re.compile(plain).findall
        self.other = re.compile(f"[{chr(PLAIN)}-\U0010ffff]").search

    @staticmethod
    def ranges(kind: str) -> str:
        found: list[list[int]] = []
        for c in map(ord, regex.findall(kind, "".join(map(chr, range(PLAIN))))):
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
        return "".join(f"\\x{a:02x}-\\x{b:02x}" if b < 256 else f"\\u{a:04x}-\\u{b:04x}" for a, b in found)

    def __call__(self, text: str) -> list[str]:
        return self.whole(text) if self.plain is None or self.other(text) else self.plain(text)


def blocks(batches: Iterator[pa.RecordBatch], pattern: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a partition's rows (doc_id, text); their cut depends on the rows alone, not on the batches."""
    split = Splitter(pattern)
    first = TaskContext.get().partitionId() << 24
    block, ids, tokens, held = Block(first), [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = text.as_py()
            ids.append(i)
            tokens.append(split(t))
            held += len(t)
            block.bytes += len(t)
            if held >= CHUNK_BYTES or block.bytes >= limit:
                block.add(ids, tokens)
                ids, tokens, held = [], [], 0
            if block.bytes >= limit:
                yield block
                block = Block(block.number + 1)
    if ids:
        block.add(ids, tokens)
    if block.ids:
        yield block


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; see the module's text."""
    spark = docs.sparkSession
    parts = PARTS * partitions(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # one vocabulary file: its size is fixed
    scan = documents(docs)

    def requests(batches):
        for b in blocks(batches, pattern):
            part, words, _ = b.by_part(parts)
            cut = np.searchsorted(part, np.arange(parts + 1))
            rows = [(p, words[cut[p] : cut[p + 1]]) for p in range(parts) if cut[p] < cut[p + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p for p, _ in rows], pa.int32()),
                    pa.array([b.number] * len(rows), pa.int64()),
                    pa.array([b.digest()] * len(rows), pa.int64()),
                    pa.array([pack(np.array([len(w) for w in ws], np.uint32)) for _, ws in rows], pa.binary()),
                    pa.array([pack(b"".join(ws)) for _, ws in rows], pa.binary()),
                ],
                names=["part", "block", "digest", "lengths", "words"],
            )

    def encode(batches):
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks.value), special_tokens={})
        known: dict[bytes, bytes] = {}  # the distinct words of this partition
        for batch in batches:
            out = []
            for lengths, words in zip(batch.column(3), batch.column(4), strict=True):
                ends = np.cumsum(unpack(lengths.as_py(), np.uint32)).tolist()
                raw, start, ids = unpack(words.as_py()), 0, []
                for end in ends:
                    w = raw[start:end]
                    start = end
                    if (x := known.get(w)) is None:
                        x = known[w] = np.array(bpe._encode_single_piece(w), np.uint32).tobytes()
                    ids.append(x)
                counts = np.array([len(x) // 4 for x in ids], np.uint32)
                out.append((pack_planes(counts), pack_planes(np.frombuffer(b"".join(ids), np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(0), pa.array([c for c, _ in out], pa.binary()), pa.array([i for _, i in out], pa.binary())],
                names=["block", "digest", "part", "counts", "ids"],
            )

    def positions(batches):
        for b in blocks(batches, pattern):
            _, _, new = b.by_part(parts)
            codes = new[np.concatenate(b.codes)] if len(new) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.number], pa.int64()), pa.array([b.digest()], pa.int64()), pa.array([b.ids], pa.list_(pa.int64())), pa.array([pack(np.array(b.counts, np.uint32))], pa.binary()), pa.array([pack_planes(codes)], pa.binary())],
                names=["block", "digest", "doc_ids", "n_words", "codes"],
            )

    def assemble(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        token_bytes = pa.array([t for t, _ in sorted(read_ranks(ranks.value).items(), key=lambda x: x[1])], pa.large_binary())
        right = right.sort_values("part")
        counts = np.concatenate([unpack_planes(x, np.uint32) for x in right["counts"]] or [np.zeros(0, np.uint32)]).astype(np.int64)
        table = np.concatenate([unpack_planes(x, np.uint32) for x in right["ids"]] or [np.zeros(0, np.uint32)])
        starts = np.cumsum(counts) - counts
        out = []
        for row in left.itertuples(index=False):
            check_digests(row.digest, right["digest"])
            codes, ends = unpack_planes(row.codes, np.int32), np.cumsum(unpack(row.n_words, np.uint32).astype(np.int64))
            at = 0
            for doc, end in zip(row.doc_ids, ends.tolist(), strict=True):
                own = codes[at:end]
                at = end
                ids = table[spread(starts[own], counts[own])]
                text = token_bytes.take(pa.array(ids))
                whole = text.buffers()[2] if len(ids) else None
                out.append((doc, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(memoryview(whole)[: len(whole)] if whole else b"").hexdigest()))
        give_back()
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        return frame.astype({"doc_id": "Int64"})

    words = scan.mapInArrow(lambda b: tidy(requests(b)), "part int, block long, digest long, lengths binary, words binary")
    ids = words.repartition(partitions(spark), "part").mapInArrow(lambda b: tidy(encode(b)), "block long, digest long, part int, counts binary, ids binary")
    codes = scan.mapInArrow(lambda b: tidy(positions(b)), "block long, digest long, doc_ids array<long>, n_words binary, codes binary")
    return (
        codes.groupBy("block")
        .cogroup(ids.groupBy("block"))
        .applyInPandas(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        .select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
    )
