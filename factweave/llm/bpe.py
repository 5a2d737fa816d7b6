"""Byte-level BPE with a two-tier lookup.

A text is cut into pre-tokens by the vocabulary's pattern. A minimal perfect hash over the vocabulary resolves a pre-token that
is itself a token; every other one is merged from its bytes, the pair of lowest rank first, by a heap over a linked list. Both
answers are remembered per worker in a bounded cache. Decoding concatenates the tokens' bytes.

Null texts are empty. Nulls in other columns pass through, extra columns are kept or ignored as each function says.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.store import small_batches
from factweave.llm.wordhash import slices

CACHE = 100_000
WORD = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, blank, rank), by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


#: The usual pattern of byte-level vocabularies (fixed value).
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same on texts of ASCII and the letters U+00C0 to U+024F; that block is letters but for two signs.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"


class Splitter:
    """Pre-tokens of a text by a pattern; texts in Latin letters take an equal expression that runs faster."""

    def __init__(self, pattern: str):
        self.any = regex.compile(pattern).findall
        self.ascii, self.latin = (re.compile(rf" ?[{x}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{x}]+|\s+(?!\S)|\s+", re.A).findall for x in ("A-Za-z", LATIN))
        self.other = re.compile(rf"[^\x00-\x7f{LATIN}]").search if pattern == USUAL else None

    def __call__(self, text: str) -> list[str]:
        if self.other is None:
            return self.any(text)
        if text.isascii():
            return self.ascii(text)
        return self.any(text) if self.other(text) else self.latin(text)


class PerfectHash:
    """Hash and displace: every key of a fixed set has a slot of its own among as many slots as keys."""

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.width = max(1, self.n // 4)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.width, []).append((h, i))
        self.shift = np.zeros(self.width, np.int64)
        self.slots = np.full(self.n, -1, np.int64)
        free = None
        for bucket, members in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) == 1:  # single keys take what is left
                free = iter(np.flatnonzero(self.slots < 0).tolist()) if free is None else free
                at = next(free)
                self.shift[bucket], self.slots[at] = -at - 1, members[0][1]
                continue
            d = 0
            while True:
                at = [self._place(h, d) for h, _ in members]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                d += 1
            self.shift[bucket] = d
            for a, (_, i) in zip(at, members, strict=True):
                self.slots[a] = i
        self.shift, self.slots = self.shift.tolist(), self.slots.tolist()

    def _place(self, h: int, d: int) -> int:
        x = (h + d * STEP) & WORD
        x ^= x >> 31
        x = x * 0xBF58476D1CE4E5B9 & WORD
        return (x ^ x >> 29) % self.n

    def index(self, key: bytes) -> int:
        """The only number that ``key`` can have; whether it has it, the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.width]
        return self.slots[-d - 1 if d < 0 else self._place(h, d)]


class Codec(dict):
    """Encoder and decoder; as a dict, the bounded cache, of two generations, from pre-token to the bytes of its ids."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokens, self.table = tokens, table
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.cut = Splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:  # the young generation becomes the old one
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            data = piece.encode()
            i = self.table.index(data)
            ids = array("I", (i,) if self.tokens[i] == data else self.merge(data)).tobytes()
        self[piece] = ids
        return ids

    def merge(self, data: bytes) -> tuple[int, ...]:
        n, rank = len(data), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank(data[i : i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:  # one of its ends was merged since
                continue
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = rank(data[i : after[k]], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = rank(data[h:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.cut(text))), np.uint32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec(shared) -> Codec:
    """The worker's own codec for broadcast (name, tokens, pattern, table)."""
    name, tokens, pattern, table = shared.value
    if name not in _codecs:
        _codecs[name] = Codec(tokens, pattern, table)
    return _codecs[name]


_built: dict[tuple[str, str], tuple] = {}


def share(docs: DataFrame, path: str, pattern: str):
    """The vocabulary and its perfect hash as a broadcast; its size is that of the vocabulary file."""
    small_batches(docs.sparkSession)
    if (path, pattern) not in _built:
        tokens = read_ranks(path)
        name = hashlib.sha256(b"\0".join([pattern.encode(), *tokens])).hexdigest()
        _built[path, pattern] = (name, tokens, pattern, PerfectHash(tokens))
    return docs.sparkSession.sparkContext.broadcast(_built[path, pattern])


def encode(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) in place of ``text``, special tokens never made."""
    shared = share(docs, path, pattern)
    schema = T.StructType([f for f in docs.schema if f.name not in ("text", ids)] + [T.StructField(ids, T.ArrayType(T.IntegerType()))])
    text = docs.select(*[c for c in docs.columns if c not in ("text", ids)], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [coder.encode(t or "").view(np.int32) for t in batch.column(batch.num_columns - 1).to_pylist()]
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))], names=schema.names)

    return text.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the bytes of ``ids`` in a column ``decoded`` (binary); null ids are null bytes."""
    shared = share(rows, path, pattern)
    schema = T.StructType([f for f in rows.schema if f.name != "decoded"] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared)
        for batch in batches:
            out = [coder.decode(x) if x is not None else None for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return rows.drop("decoded").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of the ids as little-endian uint32), decoded_sha256."""
    shared = share(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, ids_hash, text_hash = [], [], []
                for t in batch.column(1):
                    ids = coder.encode(t.as_py() or "")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest())
                    text_hash.append(hashlib.sha256(coder.decode(ids.tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
