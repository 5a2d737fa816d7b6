"""Token ids in files of bit planes.

A file holds the ids of consecutive documents, cut in blocks of a fixed number of ids. A block is transposed: plane p has bit p
of every id (or byte p, for byte planes), and each plane is a Zstandard frame. Then come a table of the documents and an index
of the chunks, both Zstandard frames, and a footer that finds them:

    "FWPLANES" | frames of planes, block by block | documents | index | footer

The documents are (doc_id int64, ids uint64) rows, the index (offset uint64, ids uint32, size of each plane uint32) rows, little
endian. Blocks can be read alone. Files are numbered in document order.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.bpe import Splitter
from factweave.llm.store import keep, open_fs, scratch_path
from factweave.llm.wordhash import slices

MAGIC, BLOCK, LEVEL, CACHE = b"FWPLANES", 1 << 16, 3, 350_000
FOOTER = struct.Struct("<IIBBHQQQQ8s")  # block, documents, planes, bit or byte, version, ids, documents at, index at, end, magic
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, planes: int, bits: bool = True) -> list[bytes]:
    """The planes of one block; ``ids`` are below 2**planes, or 256**planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, p].tobytes() for p in range(planes)]
    lanes = [raw[:, i].copy() for i in range((planes + 7) // 8)]
    return [np.packbits(lanes[p // 8] >> np.uint8(p % 8) & np.uint8(1), bitorder="little").tobytes() for p in range(planes)]


def from_planes(planes: list[bytes], n: int, bits: bool = True) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    for i in range((len(planes) + 7) // 8 if bits else len(planes)):
        if bits:
            lane = np.zeros(n, np.uint8)
            for p, plane in enumerate(planes[8 * i : 8 * i + 8]):
                lane |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little") << np.uint8(p)
        else:
            lane = np.frombuffer(planes[i], np.uint8)
        out[:, i] = lane
    return out.view("<u4").reshape(-1)


class Writer:
    """Writes one file to a binary stream, a block at a time."""

    def __init__(self, out, planes: int, bits: bool = True, block: int = BLOCK, level: int = LEVEL):
        self.out, self.planes, self.bits, self.block = out, planes, bits, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.at, self.total, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.docs, self.index = [], []
        out.write(MAGIC)

    def _flush(self, ids: np.ndarray) -> None:
        if int(ids.max()) >> (self.planes if self.bits else 8 * self.planes):
            raise ValueError("an id does not fit the planes")
        frames = [self.press.compress(p) for p in to_planes(ids, self.planes, self.bits)]
        self.index.append((self.at, len(ids), *map(len, frames)))
        for f in frames:
            self.out.write(f)
            self.at += len(f)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            full = len(every) - len(every) % self.block
            for i in range(0, full, self.block):
                self._flush(every[i : i + self.block])
            self.held, self.n_held = [every[full:]], len(every) - full

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        table = self.press.compress(np.array(self.docs, np.dtype([("doc_id", "<i8"), ("ids", "<u8")])).tobytes())
        index = self.press.compress(np.array(self.index, self.dtype(self.planes)).tobytes())
        self.out.write(table + index)
        mid = self.at + len(table)
        self.out.write(FOOTER.pack(self.block, len(self.docs), self.planes, self.bits, 1, self.total, self.at, mid, mid + len(index), MAGIC))

    @staticmethod
    def dtype(planes: int) -> np.dtype:
        return np.dtype([("at", "<u8"), ("n", "<u4")] + [(f"p{p}", "<u4") for p in range(planes)])


class Reader:
    """Reads a file through a seekable stream: the documents, any block, or all ids in order."""

    def __init__(self, src):
        self.src, self.press = src, zstandard.ZstdDecompressor()
        src.seek(0, os.SEEK_END)
        src.seek(src.tell() - FOOTER.size)
        self.block, n, self.planes, bits, version, self.total, table, index, end, magic = FOOTER.unpack(src.read(FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a file of bit planes")
        self.bits = bool(bits)
        src.seek(table)
        self.docs = np.frombuffer(self.press.decompress(src.read(index - table)), np.dtype([("doc_id", "<i8"), ("ids", "<u8")])) if n else np.zeros(0, np.dtype([("doc_id", "<i8"), ("ids", "<u8")]))
        src.seek(index)
        raw = src.read(end - index)
        self.index = np.frombuffer(self.press.decompress(raw) if self.total else b"", Writer.dtype(self.planes))

    def read_block(self, i: int) -> np.ndarray:
        row = self.index[i]
        sizes = [int(row[f"p{p}"]) for p in range(self.planes)]
        self.src.seek(int(row["at"]))
        raw, at, planes = self.src.read(sum(sizes)), 0, []
        for size in sizes:
            planes.append(self.press.decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, int(row["n"]), self.bits)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        held, i = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.docs["doc_id"].tolist(), self.docs["ids"].tolist(), strict=True):
            if n > len(held):
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.read_block(i))
                    have, i = have + len(parts[-1]), i + 1
                held = np.concatenate(parts)
            yield doc_id, held[:n]
            held = held[n:]


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where it has one, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Ids by the tokenizers library, for a byte-level BPE. It treats pre-tokens apart, so each distinct one is encoded once;
    as a dict, this is the bounded cache, of two generations, from pre-token to the bytes of its ids.

    Pre-tokens are cut here by the vocabulary's pattern and handed to the library's model in its byte alphabet. With ``special``,
    texts are first split at the definition's added tokens, which become their ids, as the library does when loaded; else those
    strings are ordinary text.
    """

    def __init__(self, definition: str, pattern: str, special: bool = False):
        super().__init__()
        self.old: dict[str, bytes] = {}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.alphabet = byte_alphabet()
        self.tokens = Tokenizer.from_str(definition).model.tokenize
        self.cut = Splitter(pattern)
        added = json.loads(definition).get("added_tokens") or [] if special else []
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that reach beyond their own text are not supported")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        self.mark = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")

    def pieces(self, text: str) -> list[str]:
        if not self.added or not self.mark.search(text):
            return self.cut(text)
        return list(chain.from_iterable([p] if p in self.added else self.cut(p) for p in self.mark.split(text) if p))

    def shown(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():  # stands for itself but for blanks
            return piece.replace(" ", self.alphabet[32])
        return piece.encode().decode("latin-1").translate(self.alphabet)

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:  # the young generation becomes the old one
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece) or self.added.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.tokens(self.shown(piece))]).tobytes()
        self[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(map(self.__getitem__, self.pieces(t))), "<u4") for t in texts]


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = zlib.crc32(shared.value[0].encode())
    if key not in _encoders:
        _encoders[key] = Encoder(*shared.value, special=True)
    return _encoders[key]


def write(docs: DataFrame, path: str, definition: str, pattern: str, end_id: int = 0, planes: int = 16, bits: bool = True) -> list[tuple[str, int, int]]:
    """Writes ids of ``docs`` (doc_id, text), each document closed by ``end_id``, in ascending doc_id order, nulls last.

    A null text is empty; strings of the definition's added tokens become those tokens. Rows that repeat are written each. Returns (file, documents, ids) in order. A file appears under its
    final name only when whole, so a task that runs again does no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast((definition, pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.planes"
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}.{task.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            made = Writer(out, planes, bits)
            for whole in batches:
                for batch in slices(whole, "text", 4 << 20):
                    ids = _encoder(shared).encode([t or "" for t in batch.column(1).to_pylist()])
                    for doc_id, x in zip(batch.column(0).to_pylist(), ids, strict=True):
                        made.add(NO_ID if doc_id is None else doc_id, np.append(x, np.uint32(end_id)))
            made.close()
        fs.move(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(made.docs)], pa.int64()), pa.array([made.total], pa.int64())], names=["file", "docs", "ids"])

    return sorted((r["file"], r["docs"], r["ids"]) for r in keep(rows.mapInArrow(run, "file string, docs long, ids long"), "files").collect())


def read(spark: SparkSession, path: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 (of the ids as little-endian uint32) of the documents in ``files``."""
    plan, at = [], 0
    for name, docs, ids in files:
        if docs:
            plan.append((name, at))
        at += ids
    where = spark.createDataFrame(plan, "file string, base long").repartition(max(1, len(plan)), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as src:
                    rows = []
                    for doc_id, ids in Reader(src).documents():
                        rows.append((None if doc_id == NO_ID else doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return where.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, definition: str, pattern: str) -> DataFrame:
    """Files in the shared folder, written and read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "planes")
    return read(spark, path, write(docs, path, definition, pattern))
