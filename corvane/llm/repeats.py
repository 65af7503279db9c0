"""Stretches of documents whose windows of a fixed number of tokens start at two places or more.

The exact question, for windows of W tokens, is asked of a few keys instead of every window:

1. *Anchors.* Each window names the gram of K tokens inside it whose hash is smallest (the
   leftmost of equals). Equal windows name equal grams at equal offsets, so windows can only
   repeat where an anchor repeats, and neighbouring windows mostly name the same anchor: about
   2 / (W - K + 2) anchors a token are shuffled. An anchor's *factor* is the run of windows that
   name it. If all factors of an anchor are equal, all their windows repeat.
2. *Cells.* Where the factors of an anchor differ, the edges of repeats lie. Windows are taken in
   cells by their offset to the anchor. The windows of a cell have a common core: a core that
   occurs once has no repeated window; if all full cells of a core are equal, all their windows
   repeat. Cells that are still open are taken apart into smaller ones, size by size.
3. *Windows* of the cells that are still open are compared one by one.

Each step has the same form: rows (h, s, ..) where windows can only repeat inside an h and do so
wholly where all s of the h are equal; what is left goes to the next step. Counting by h is a
pre-aggregated sum and the way back a join on a hash of h, whose hot partitions Spark can split,
so a passage that a third of all documents share isn't gathered anywhere; only a document's own
rows are. Texts are shuffled by document, once
for all steps, where Spark reuses the exchange. Equality is of 64-bit hashes. Factors and cells are compared under their anchor or core only, and
single windows with all other open ones, about 4 % of all where copies differ in places: n of these
have some n * n / 2**65 accidental pairs, which is none up to a few billion, and at a hundred
terabytes a few windows in ten million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.documents import keyed
from corvane.llm.groups import rejoined
from corvane.llm.tokens import U64, Prefix, mix, slices

_STEP = (1 << 20) - 4096
_INDEX = U64((1 << 21) - 1)
_LEVEL = "h long, s long, _d long, _t long, p long"

#: bytes and row borders of a slice -> tokens as 64-bit integers and row borders in tokens
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(lo: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Window starts lo .. lo+n-1 of a document, whose anchor is at lo + off."""
    return (lo << 20) | (off << 10) | n


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return p >> 20, (p >> 10) & 1023, p & 1023


def anchors(tokens: np.ndarray, borders: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, lo, off, n, h, s) of every factor in rows of tokens."""
    width, parts = window - gram + 1, []
    row_of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    for at in range(0, max(0, len(tokens) - window + 1), _STEP):
        piece = tokens[at : at + _STEP + window - 1].astype(U64)
        hashes = Prefix(piece)
        i = np.arange(len(piece) - gram + 1)
        g = hashes(i, i + gram)
        m, span = (g & ~_INDEX) | i.astype(U64), 1
        while span * 2 <= width:
            m, span = np.minimum(m[:-span], m[span:]), span * 2
        m = np.minimum(m[: len(piece) - window + 1], m[width - span :][: len(piece) - window + 1])
        rows = row_of[at : at + len(piece)]
        start = np.flatnonzero(rows[: len(m)] == rows[window - 1 :])
        if not len(start):
            continue
        anchor = (m[start] & _INDEX).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(start) != 1)])
        lo, a, n = start[first], anchor[first], np.diff(np.r_[first, len(start)])
        s = mix(hashes(lo, lo + n + window - 1) ^ pack(lo * 0, a - lo, n).astype(U64))
        parts.append((rows[lo], lo + at - borders[rows[lo]], a - lo, n, g[a], s))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def stretch_hashes(tokens: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of stretches of up to 4096 tokens, sorted by lo."""
    out, i = np.empty(len(lo), dtype=U64), 0
    while i < len(lo):
        j = int(np.searchsorted(lo, lo[i] + _STEP))
        base = lo[i]
        hashes = Prefix(tokens[base : hi[i:j].max()].astype(U64))
        out[i:j] = hashes(lo[i:j] - base, hi[i:j] - base)
        i = j
    return out


def cells(tokens: np.ndarray, start: np.ndarray, lo: np.ndarray, off: np.ndarray, n: np.ndarray, window: int, cell: int, unique: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, lo, off, n, h, s) of the cells of parts; start is where a part's document begins in tokens."""
    low, high = (off - n + 1) // cell, off // cell
    count = high - low + 1
    part = np.repeat(np.arange(len(lo)), count)
    b = low[part] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a = lo[part] + off[part]
    j_hi, j_lo = np.minimum(b * cell + cell - 1, off[part]), np.maximum(b * cell, (off - n + 1)[part])
    at = a + start[part]
    order = np.argsort(at - b * cell, kind="stable")
    core = np.empty(len(part), dtype=U64)
    core[order] = stretch_hashes(tokens, (at - b * cell)[order], (at - b * cell - cell + 1 + window)[order])
    whole = np.flatnonzero(j_hi - j_lo + 1 == cell)
    s = mix(unique[part] + (b * cell + j_lo * 1024).astype(U64))
    order = whole[np.argsort((at - b * cell)[whole], kind="stable")]
    s[order] = stretch_hashes(tokens, (at - b * cell - cell + 1)[order], (at - b * cell + window)[order])
    return part, a - j_hi, j_hi, j_hi - j_lo + 1, mix(core ^ (b + 1).astype(U64)), s


def windows(tokens: np.ndarray, start: np.ndarray, lo: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, lo, h) of every window of parts."""
    part = np.repeat(np.arange(len(lo)), n)
    own = lo[part] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = own + start[part]
    order = np.argsort(at, kind="stable")
    h = np.empty(len(part), dtype=U64)
    h[order] = stretch_hashes(tokens, at[order], at[order] + window)
    return part, own, h


def _rows(h: np.ndarray, s: np.ndarray, d: np.ndarray, t: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(h), 100_000):
        own = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(s[own].view(np.int64)), pa.array(d[own]), pa.array(t[own]), pa.array(p[own])], ["h", "s", "_d", "_t", "p"])


def _column(batch: pa.RecordBatch, name: str, lo: int, hi: int) -> np.ndarray:
    return batch.column(name).slice(lo, hi - lo).to_numpy(zero_copy_only=False)


def repeated_windows(docs: DataFrame, tokenise: Tokens, window: int, gram: int, sizes: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows ``keyed`` of the documents, and (_d, _t, starts): packed runs of repeated window starts.

    ``sizes`` are those of the cells, each a multiple of the next.
    """
    rows = keyed(docs)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, borders in slices(batch.column("text")):
                row, at, off, n, h, s = anchors(*tokenise(data, borders), window, gram)
                yield from _rows(h, s, _column(batch, "_d", lo, hi)[row], _column(batch, "_t", lo, hi)[row], pack(at, off, n))

    def opened(cell: int):
        def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, borders in slices(batch.column("text")):
                    tokens, starts = tokenise(data, borders)
                    open_parts = batch.column("parts").slice(lo, hi - lo)
                    p = open_parts.flatten().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(hi - lo), open_parts.value_lengths().to_numpy(zero_copy_only=False))
                    d, t = _column(batch, "_d", lo, hi), _column(batch, "_t", lo, hi)
                    at, off, n = unpack(p)
                    for i in range(0, len(p), 2000):
                        own = slice(i, i + 2000)
                        base = starts[row[own]]
                        if cell == 1:
                            part, first, h = windows(tokens, base, at[own], n[own], window)
                            yield from _rows(h, np.zeros(len(h), U64), d[row[own][part]], t[row[own][part]], pack(first, first * 0, first * 0 + 1))
                        else:
                            unique = mix(d[row[own]].view(U64) ^ mix(t[row[own]].view(U64)) ^ (p[own].view(U64) * U64(31)))
                            part, first, j, m, h, s = cells(tokens, base, at[own], off[own], n[own], window, cell, unique)
                            yield from _rows(h, s, d[row[own][part]], t[row[own][part]], pack(first, j, m))

        return level

    found, level = [], rows.mapInArrow(factor, _LEVEL)
    for cell in (*sizes, 1, None):
        groups = level.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n > 1").select("h", (F.col("s0") != F.col("s1")).alias("open"))
        shared = rejoined(level, groups, "h")
        found.append(shared.where("not open").select("_d", "_t", "p"))
        if cell is None:
            break
        parts = shared.where("open").groupBy("_d", "_t").agg(F.collect_set("p").alias("parts"))
        level = rows.join(parts, ["_d", "_t"])
        level = level.select("text", "_d", "_t", "parts").mapInArrow(opened(cell), _LEVEL)
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return rows, every.groupBy("_d", "_t").agg(F.collect_set("p").alias("starts"))


def covered(n_tokens: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of a document's tokens lie in a repeated window."""
    change = np.zeros(n_tokens + 1, dtype=np.int32)
    lo, _, n = unpack(starts)
    np.add.at(change, lo, 1)
    np.add.at(change, np.minimum(lo + n + window - 1, n_tokens), -1)
    return np.cumsum(change[:-1]) > 0
