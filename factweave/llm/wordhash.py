"""Vectorised word boundaries and polynomial hashes over Arrow text columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which on UTF-8 equals ``[^\\x20\\x09-\\x0D]+`` on code points.
Hashes are Rabin-Karp polynomials modulo 2**64, finished with a bit mixer; they depend on the content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
TILE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
NO_LETTER = SPACE | np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, TILE_BYTES + 64), base & (2**64 - 1), U)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``limit`` bytes of text, or one row."""
    _, offs = text_buffer(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some documents: byte spans, hashes and the first word of each document."""

    def __init__(self, column: pa.Array, lower: bool = False, space: np.ndarray = SPACE):
        self.data, self.offs = text_buffer(column)
        self.docs = len(self.offs) - 1
        n = len(self.data)
        self.space = space[self.data]
        begin, end = np.ones(n, bool), np.ones(n, bool)
        begin[1:], end[:-1] = self.space[:-1], self.space[1:]
        edges = self.offs[(self.offs > 0) & (self.offs < n)]
        begin[edges], end[edges - 1] = True, True
        self.starts = np.flatnonzero(begin & ~self.space)
        self.ends = np.flatnonzero(end & ~self.space) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        self.counts = np.diff(self.first)
        self.lower = lower

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Of the words, or of their first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        out = np.empty(len(self.starts), U)
        at = 0
        while at < len(out):
            lo = self.starts[at]
            to = max(at + 1, int(np.searchsorted(ends, lo + TILE_BYTES, side="right")))
            hi = ends[to - 1]
            part = self.data[lo:hi]
            sums = (LOWER[part] if self.lower else part).astype(U)
            sums += U(1)
            sums *= _power("up", BASE, hi - lo)[: hi - lo]
            np.cumsum(sums, out=sums)
            s, e = self.starts[at:to] - lo, ends[at:to] - lo
            before = np.where(s > 0, sums[s - 1], U(0))
            raw = (sums[e - 1] - before) * _power("down", BASE_INV, hi - lo)[s]
            out[at:to] = mix(raw + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            at = to
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts as word numbers, first window of each document) of the k-word windows inside documents."""
        n = np.maximum(self.counts - k + 1, 0)
        ok = np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return ok, np.concatenate(([0], np.cumsum(n)))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive values, by doubling; result i covers values i to i+k-1."""
    out, have, size, power = None, 0, 1, base
    part = h
    while True:
        if k & size:
            if out is None:
                out, have = part, size
            else:
                m = len(h) - (have + size) + 1
                out, have = out[: max(m, 0)] * U(pow(base, size, 1 << 64)) + part[have : have + max(m, 0)], have + size
        size *= 2
        if size > k:
            return out
        m = max(len(h) - size + 1, 0)
        part = part[:m] * U(power) + part[size // 2 : size // 2 + m]
        power = power * power & (2**64 - 1)


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
