"""Words of a column of texts as flat numpy arrays, for vectorised steps inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags: True for a byte of a word, False for the given ranges."""
    flags = np.ones(256, dtype=bool)
    for low, high in ranges:
        flags[low : high + 1] = False
    return flags


# [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ ; bytes of multi-byte characters are word bytes
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
ALPHANUMERIC = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


class Hasher:
    """A polynomial hash of byte runs with its own random byte values and base."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
        self.base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of bytes."""
        return self.runs(self.values[data], start, end)

    def runs(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each run of 64-bit values."""
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n + n // 4), _powers(self.inverse, n + n // 4)
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(values * self.up[: n - 1], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64) * _ODD)


HASH = Hasher(7)
HASH2 = Hasher(11)


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower-cased where asked
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    row: np.ndarray  # the text of each word
    first: np.ndarray  # first word of each text, and the number of words at the end
    apart: np.ndarray | None = None

    def hashes(self, hasher: Hasher = HASH) -> np.ndarray:
        return hasher.of(self.data, self.start, self.end)

    def text(self, begin: int, end: int) -> bytes:
        """Words joined by one space."""
        if self.apart is None:
            # how many of the words so far do not follow their predecessor after one space
            odd = np.ones(len(self.start), dtype=np.int64)
            near = self.start[1:] == self.end[:-1] + 1
            odd[1:][near] = self.data[self.end[:-1][near]] != 0x20
            self.apart = np.cumsum(odd)
        if end > begin and self.apart[end - 1] == self.apart[begin]:
            return self.data[self.start[begin] : self.end[end - 1]].tobytes()
        return b" ".join([self.data[s:e].tobytes() for s, e in zip(self.start[begin:end], self.end[begin:end])])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a column of texts; a null is an empty text."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, word_bytes: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of word bytes in each text."""
    data, offsets = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text begins or ends before this byte
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, start, end, row, first)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; shorter by n - 1 than the input."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * _ODD + hashes[j : j + len(out)]
    return mix(out)
