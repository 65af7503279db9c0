"""Filter interaction audit: what each filter removes at every step of every order of filters.

A document fails a set of filters, its mask. Documents are counted by part (source) and mask, at
most 32 cells a part, and everything else is arithmetic on these counts. A walk over all subsets
of filters in Gray-code order toggles one filter at a time: each mask cell has a counter of the
active filters that it fails, and cells whose counter leaves or reaches zero leave or join the
running survivors. The survivors of the 32 states are stored; a step of an order goes from one state to
another, so what it removes is the difference of two of them.

The filters (null text: empty; words: maximal ``[^\\x20\\x09-\\x0D]+``): A under ``MIN_WORDS`` words,
B less than half of the words distinct, C over two in a hundred code points are ``[A-Z]``, D holds
any of ``#$%&*|``, E equals the text of a smaller doc_id anywhere in the table. Texts are compared by
a 128-bit hash; only (id, part, mask, hash) is shuffled, never text, and a text that a third of
all rows share is aggregated before the shuffle and joined back on a key that Spark can split.

A null doc_id is not smaller than any and none is smaller than it: such rows fail no E and cause
none. Rows with one id and one text are counted each and cause no E among themselves. A null
source is the part "" together with an empty one. A document is good or toxic if any label row of its
id says so; null labels and null ids say nothing. Other columns are not used. An empty table has no parts and
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import strings
from corvane.tables import written

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 2
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

_CAPITALS = bytes(range(65, 91))
_TRAILING = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[ \t-\r]")
_PIECE = 1 << 20
_PARTS = 100


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that end before a space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text fails, A the lowest bit."""
    n, distinct = 0, set()
    for piece in _pieces(text):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _TRAILING))
    return (n < MIN_WORDS) | (100 * len(distinct) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2 | (_MARKS.search(text) is not None) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, high, low = [], [], []
        for text in strings(batch.column("text")):
            h = xxhash.xxh3_128_intdigest(text)
            masks.append(failures(text))
            high.append((h >> 64) - (1 << 63))
            low.append((h & ((1 << 64) - 1)) - (1 << 63))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["doc_id", "part", "mask", "h", "g"])


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask), a row a document: the filters A to E that it fails."""
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = written(read.mapInArrow(_masks, "doc_id long, part string, mask int, h long, g long"), "masks")
    shared = rows.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(F.col("h").alias("_h"), F.col("g").alias("_g"), "first")
    same = (F.xxhash64("h", "g") == F.xxhash64("_h", "_g")) & (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))  # see groups.rejoined
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(shared, same, "left").select("doc_id", "part", F.when(late, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail just these filters."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    joined = masks.join(known, F.col("doc_id") == F.col("_id"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def survivors(cells: np.ndarray, filters: int) -> np.ndarray:
    """Of cells (parts, masks, measures), what survives each set of active filters, by a Gray-code walk."""
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, dtype=np.int64)
    alive = cells.sum(axis=1)
    out = np.empty_like(cells)
    out[:, 0] = alive
    state = 0
    for step in range(1, 1 << filters):
        bit = step & -step
        state ^= bit
        has = (masks & bit) > 0
        if state & bit:
            alive = alive - cells[:, has & (failing == 0)].sum(axis=1)
            failing[has] += 1
        else:
            failing[has] -= 1
            alive = alive + cells[:, has & (failing == 0)].sum(axis=1)
        out[:, state] = alive
    return out


def _steps(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each step of each order: the order's name, the step, its filter, and the states before and after."""
    names, steps, filters, before, after = [], [], [], [], []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            names.append("".join(letters[x] for x in order))
            steps.append(step)
            filters.append(f)
            before.append(state)
            state |= 1 << f
            after.append(state)
    return names, *(np.array(x) for x in (steps, filters, before, after))


def _walk(letters: str):
    k, full = len(letters), (1 << len(letters)) - 1

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps, filters, before, after = _steps(letters)
        for batch in batches:
            for at in range(0, batch.num_rows, _PARTS):
                piece = batch.slice(at, _PARTS)
                parts = piece.column("part").to_pylist()
                cells = np.zeros((len(parts), 1 << k, 3), dtype=np.int64)
                for i, found in enumerate(piece.column("cells").to_pylist()):
                    for c in found:
                        cells[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                alive = survivors(cells, k)
                gone = alive[:, before] - alive[:, after]
                bits = 1 << np.arange(k)
                fails = alive[:, :1, 0] - alive[:, bits, 0]
                unique = alive[:, full ^ bits, 0] - alive[:, full:, 0]
                shapley = np.stack([gone[:, filters == f, 0].sum(axis=1) for f in range(k)], axis=1)
                counts = [alive[:, after, 0], gone[:, :, 0], fails[:, filters] - gone[:, :, 0], unique[:, filters], gone[:, :, 1], gone[:, :, 2], shapley[:, filters]]
                n = len(names)
                arrays = [pa.array(np.repeat(np.array(parts, object), n), pa.string()), pa.array(names * len(parts), pa.string()), pa.array(np.tile(steps, len(parts)).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x.ravel()) for x in counts)], ["part", "filter_order", "step", *COUNTS])

    return walk


def order_steps(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order of the filters and step, of cells (part, mask, n, good, toxic); letter i is bit i of a mask."""
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most a cell a mask
    return by_part.mapInArrow(_walk(letters), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return order_steps(mask_cells(document_masks(docs), labels))
