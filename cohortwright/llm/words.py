"""Vectorised words of a column of texts: positions and hashes read off the UTF-8 bytes of an Arrow batch.

Both word rules of the operators only name ASCII bytes, and every byte of a longer UTF-8 character is
128 or more, so cutting bytes gives the same words as cutting characters. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_byte = np.arange(256)
#: Words ``[^\x20\x09-\x0D]+``.
SPACED = ~((_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D)))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z became a-z.
PLAIN = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Cache(dict):
    """Tables that a task makes once; they don't travel with the task's function."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def _power(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of consecutive documents: bytes, [start, end) of each word, and each document's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.per_doc)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_VALUE[self.data] * _power(_BASE, n + 1)[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power(_BASE_INVERSE, n + 1)[self.starts])

    def spaced(self, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The kept words of all documents, joined by one space in each, and the byte offset of each document."""
        kept = np.flatnonzero(keep)
        doc = np.searchsorted(self.offsets, kept, side="right") - 1
        more = np.zeros(len(kept), bool)
        more[:-1] = doc[1:] == doc[:-1]
        change = np.zeros(len(self.data) + 1, np.int8)
        change[self.starts[kept]] = 1
        # A word that isn't the last kept one takes the byte after it along, as its space.
        last = self.ends[kept] + more
        np.add.at(change, last, -1)
        inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
        out = self.data.copy()
        out[self.ends[kept[more]]] = 0x20
        size = np.bincount(doc, last - self.starts[kept], len(self.offsets) - 1).astype(np.int64)
        return out[inside].tobytes(), np.concatenate(([0], np.cumsum(size)))

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def joined(self, first: int, last: int) -> bytes:
        return b" ".join(self.text(i) for i in range(first, last))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the byte offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def cut(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return Words(data, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each (a longer text stands alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // size
    at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    for a, b in zip(at, at[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def grams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, out = np.uint64(2 * seed + 0xD1B54A32D192ED03 & (1 << 64) - 1 | 1), np.zeros(n, np.uint64)
    for j in range(k):
        out *= factor
        out += hashes[j : j + n]
    return mix(out)


def fits(words: Words, k: int) -> np.ndarray:
    """Whether the k words from each position of ``grams`` lie in one document."""
    n = len(words.starts) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(words.offsets[1:], words.per_doc) - np.arange(len(words.starts))
    return left[:n] >= k


def minima(g: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least of any w neighbouring hashes; all of them where several are equal.

    ``whole``: whether the w hashes from a position on belong to one document.
    """
    n = len(g) - w + 1
    chosen = np.zeros(len(g), bool)
    if n <= 0:
        return chosen
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    for j in range(w):
        chosen[j : j + n] |= (g[j : j + n] == least) & whole[:n]
    return chosen


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any interval [first, last)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0
