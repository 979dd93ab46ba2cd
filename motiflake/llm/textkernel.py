"""Words of many texts at once, on their UTF-8 bytes with numpy.

A batch of texts is one byte buffer with offsets. Words are found by a byte table (in UTF-8 every byte of a code
point above 127 is above 127, so tables over bytes and classes over code points agree) and hashed by differences of
one running sum, so no Python code runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
STEP = 0xC2B2AE3D27D4EB4F | 1
STEP_INV = pow(STEP, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SOLID = np.ones(256, bool)  # [^\x20\x09-\x0D]
SOLID[0x20] = SOLID[9:14] = False

LOW = 16


@cache
def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(2**LOW - 1), and the powers of base**(2**LOW) up to a length of 2**31, modulo 2**64."""
    out = []
    for b, n in ((base, 1 << LOW), (pow(base, 1 << LOW, 1 << 64), 1 << (31 - LOW))):
        t = np.full(n, b, np.uint64)
        t[0] = 1
        out.append(np.multiply.accumulate(t))
    return out[0], out[1]


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, from two small tables."""
    low, high = _tables(base)
    return low[at & ((1 << LOW) - 1)] * high[at >> LOW]


def running(values: np.ndarray, base: int) -> np.ndarray:
    """n + 1 running sums of values[i] * base**i modulo 2**64, from 0; bytes stand for their MIX values."""
    n, step = len(values), 1 << LOW
    out = np.zeros(n + 1, np.uint64)
    low, high = _tables(base)
    for a in range(0, n, step):
        part = values[a : a + step]
        part = (MIX[part] if part.dtype == np.uint8 else part) * low[: len(part)]
        part *= high[a >> LOW]
        part[:1] += out[a : a + 1]
        np.cumsum(part, out=out[a + 1 : a + 1 + len(part)])
    return out


def shifted(values: np.ndarray, base: int) -> np.ndarray:
    """values[i] * base**i modulo 2**64, in place."""
    step = 1 << LOW
    low, high = _tables(base)
    for a in range(0, len(values), step):
        part = values[a : a + step]
        part *= low[: len(part)]
        part *= high[a >> LOW]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


@dataclass
class Words:
    """Words of a batch: byte spans, and for text d the words first[d] to first[d + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, w: int) -> bytes:
        return self.data[self.start[w] : self.end[w]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, equal for equal bytes wherever they stand."""
        run = running(self.data, BASE)
        return mix((run[self.end] - run[self.start]) * power(BASE_INV, self.start) + (self.end - self.start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Maximal runs of bytes in table; none crosses the end of a text."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive values of h (len(h) - n + 1 of them); windows over two texts are to be masked out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    run = running(h, STEP)
    return mix(shifted(run[n:] - run[:-n], STEP_INV) + np.uint64(n))


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words lie inside one text."""
    total = int(first[-1])
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    last = first[1:]
    for k in range(1, n):  # the k windows before a text's end reach beyond it
        at = last - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok
