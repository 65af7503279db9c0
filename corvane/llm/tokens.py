"""Vectorised text handling on the buffers of Arrow string columns.

Everything here works on slices of a batch: a few megabytes of UTF-8 bytes of
whole documents, so that memory is bounded by the slice or by the largest single
document, never by a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_CHUNK = 1 << 20
U64 = np.uint64

#: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: as SPACE, and every ASCII character that is neither letter nor digit
BREAK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_P = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0 .. P**n and their inverses, modulo 2**64."""
    inverse = pow(_P, -1, 1 << 64)
    up, down = np.full(n + 1, _P, dtype=U64), np.full(n + 1, inverse, dtype=U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


class Prefix:
    """Hashes of any stretch of up to 2**20 tokens, from one pass of prefix sums."""

    def __init__(self, tokens: np.ndarray):
        up, self._down = powers(max(_CHUNK, 1 << max(0, len(tokens) - 1).bit_length()))
        self._sum = np.zeros(len(tokens) + 1, dtype=U64)
        np.cumsum(tokens * up[: len(tokens)], dtype=U64, out=self._sum[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sum[hi] - self._sum[lo]) * self._down[lo])


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi, their bytes, and the offsets of hi-lo+1 row borders in these bytes. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, borders: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row border the index of the first word after it."""
    n = len(data)
    solid = ~space[data]
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = borders[(borders > 0) & (borders < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, borders)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, in pieces of a bounded number of bytes."""
    out = np.empty(len(start), dtype=U64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + _CHUNK, side="right"))
        if j <= i:  # one word of over a megabyte
            out[i] = int.from_bytes(blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
            i += 1
            continue
        piece = Prefix(data[start[i] : end[j - 1]].astype(U64) + U64(1))
        out[i:j] = piece(start[i:j] - start[i], end[i:j] - start[i])
        i = j
    return out


def strings(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each row, one by one. Null is empty."""
    for lo, hi, data, borders in slices(column):
        for i in range(hi - lo):
            yield data[borders[i] : borders[i + 1]].tobytes()
