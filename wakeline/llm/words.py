"""Words of many texts at once: numpy over the bytes of an Arrow column.

A word is a maximal run of code points other than space and U+0009 to U+000D. Texts are
taken in chunks of about a megabyte (at least one whole text), so that the arrays of a chunk
stay small however long a batch is. Words, lines and word sequences are compared by 64-bit
hashes that depend on nothing but the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEPARATORS = b" \t\n\v\f\r"

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(_SEPARATORS)] = True
#: First bytes of code points: all but UTF-8 continuation bytes.
IS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Chunk(NamedTuple):
    """Consecutive texts of a batch: rows ``first`` to ``first + len(offsets) - 1``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text the mask marks."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words(NamedTuple):
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Bytes of a string column in chunks; nulls are empty texts."""
    if len(column) == 0:
        return
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(chunk: Chunk) -> Words:
    """Text number, first byte and end of every word."""
    n = len(chunk.data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    gap = IS_SEPARATOR[chunk.data]
    new = np.zeros(n + 1, bool)
    new[chunk.offsets] = True
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1] | new[1:n]
    ends[:-1] &= gap[1:] | new[1:n]
    start = np.flatnonzero(begins)
    text = np.searchsorted(chunk.offsets, start, side="right") - 1
    return Words(text, start, np.flatnonzero(ends) + 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; spans ascend and do not overlap."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    before = np.cumsum(size) - size
    place = np.arange(total) - np.repeat(before, size)
    power = np.empty(int(size.max()) + 1, np.uint64)
    power[0] = 1
    power[1:] = _ODD
    np.cumprod(power, out=power)
    value = _BYTE[data[place + np.repeat(start, size)]] * power[place]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return mix(sums[before + size] - sums[before] + size.astype(np.uint64) * _ODD)


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive hashes, in order; ``len(h) - k + 1`` of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : i + n]
    return mix(out)


def keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made different for different texts of a chunk."""
    return mix(h + text.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def text_hashes(chunk: Chunk) -> np.ndarray:
    """Hash of each whole text."""
    return span_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:])
