"""What two versions of a thing have in common: texts by lines, pictures by hashes, files by bytes.

Texts are compared by a longest common subsequence of lines. What both begin and end with is cut off; in
between the subsequence is found with a row of bits for each line (one addition and two logical
operations on whole rows), which is exact. Only where that would take over ``MOST_BITS`` bits are the
texts first split at lines that occur once in each, as far as these stand in one order in both.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 31
MOST_HUNKS = 300
MOST_LINES = 40

#: Up to how many differing bits of 64 two pictures are one, or are related.
SAME_PICTURE, RELATED_PICTURE = 5, 12

_HUNK = "struct<tag:string,a_start:int,a_lines:array<string>,b_start:int,b_lines:array<string>>"
_HUNK_TYPE = pa.list_(pa.struct([("tag", pa.string()), ("a_start", pa.int32()), ("a_lines", pa.list_(pa.string())), ("b_start", pa.int32()), ("b_lines", pa.list_(pa.string()))]))


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places (i, j) of equal items, rising in both, as many as there can be."""
    held: dict = {}
    for j, x in enumerate(b):
        held[x] = held.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        both = row & held.get(x, 0)
        row = ((row + both) | (row - both)) & full
        rows.append(row)
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Places of items that occur once in each, the longest run of them that rises in both."""
    once_a, once_b = Counter(a), Counter(b)
    where = {x: j for j, x in enumerate(b) if once_b[x] == 1}
    pairs = [(i, where[x]) for i, x in enumerate(a) if once_a[x] == 1 and x in where]
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        ends[at : at + 1] = [j]
        tails[at : at + 1] = [n]
        before.append(tails[at - 1] if at else -1)
    out, n = [], tails[-1] if tails else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def matched(a: list, b: list, most_bits: int = MOST_BITS) -> list[tuple[int, int]]:
    """Places (i, j) of the lines that two versions have in common."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(i, i) for i in range(lo)]
    inner_a, inner_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(inner_a) * len(inner_b) <= most_bits:
        out += [(lo + i, lo + j) for i, j in common_lines(inner_a, inner_b)]
    else:
        i0 = j0 = 0
        for i, j in [*_anchors(inner_a, inner_b), (len(inner_a), len(inner_b))]:
            part_a, part_b = inner_a[i0:i], inner_b[j0:j]
            if len(part_a) * len(part_b) <= most_bits:  # without anchors in between, such a stretch counts as changed
                out += [(lo + i0 + x, lo + j0 + y) for x, y in common_lines(part_a, part_b)]
            if i < len(inner_a):
                out.append((lo + i, lo + j))
            i0, j0 = i + 1, j + 1
    return out + [(len(a) - hi + n, len(b) - hi + n) for n in range(hi)]


def changes(a: list, b: list, common: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Runs of edits (tag, a_from, a_to, b_from, b_to) between lines that are in common."""
    out = []
    i0 = j0 = 0
    for i, j in [*common, (len(a), len(b))]:
        if i > i0 or j > j0:
            out.append(("replace" if i > i0 and j > j0 else "delete" if i > i0 else "insert", i0, i, j0, j))
        i0, j0 = i + 1, j + 1
    return out


def _diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["similarity", "a_lines", "b_lines", "same_lines", "added", "removed", "n_hunks"]
    for batch in batches:
        rows, hunks = [], []
        for x, y in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True):
            a, b = (x or "").splitlines(), (y or "").splitlines()
            common = matched(a, b)
            runs = changes(a, b, common)
            total = len(a) + len(b)
            rows.append((round(2 * len(common) / total, 4) if total else 1.0, len(a), len(b), len(common), len(b) - len(common), len(a) - len(common), len(runs)))
            hunks.append([{"tag": t, "a_start": i0 + 1, "a_lines": a[i0:i1][:MOST_LINES], "b_start": j0 + 1, "b_lines": b[j0:j1][:MOST_LINES]} for t, i0, i1, j0, j1 in runs[:MOST_HUNKS]])
        columns = [pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)] if rows else [pa.array([], pa.float64() if n == "similarity" else pa.int64()) for n in names]
        yield pa.RecordBatch.from_arrays([batch.column("a_id"), batch.column("b_id"), *columns, pa.array(hunks, _HUNK_TYPE)], ["a_id", "b_id", *names, "hunks"])


def compared_texts(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, similarity, a_lines, b_lines, same_lines, added, removed, n_hunks, hunks) of pairs (a_id, b_id, a_text, b_text).

    Whole texts are compared; of the hunks the first MOST_HUNKS are shown with MOST_LINES lines each side. Null texts are empty, and two empty ones are alike.
    """
    read = pairs.select(F.col("a_id").cast("long"), F.col("b_id").cast("long"), "a_text", "b_text")
    return read.mapInArrow(_diff, f"a_id long, b_id long, similarity double, a_lines long, b_lines long, same_lines long, added long, removed long, n_hunks long, hunks array<{_HUNK}>")


def versions(docs: DataFrame, item: Column) -> DataFrame:
    """(a_id, b_id, a_text, b_text): each document (doc_id, text) with the first one of the same item.

    The first is aggregated and joined back, so that documents of an item with very many versions needn't meet in one task.
    """
    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64(item).alias("k"), item.alias("item")).where("item is not null")
    first = keyed.groupBy("k", "item").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "item", "first")
    later = keyed.join(first, ["k", "item"]).where("doc_id <> first").select(F.col("doc_id").alias("b_id"), F.col("text").alias("b_text"), F.col("first").alias("a_id"))
    return later.join(docs.select(F.col("doc_id").alias("a_id"), F.col("text").alias("a_text")).dropDuplicates(["a_id"]), "a_id").select("a_id", "b_id", "a_text", "b_text")


def picture_verdict(distance: Column, same_bytes: Column | None = None) -> Column:
    """What the number of differing bits of two perceptual hashes says: the same file, same, related or different."""
    verdict = F.when(distance <= SAME_PICTURE, "same").when(distance <= RELATED_PICTURE, "related").otherwise("different")
    return verdict if same_bytes is None else F.when(same_bytes, "identical").otherwise(verdict)
