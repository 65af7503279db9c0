"""Benchmark decontamination with SimHash of item-sized windows and multi-index Hamming blocks.

Words are maximal runs of letters and digits with A-Z lower-cased, so changes of punctuation, case
and spacing don't hide a passage. An item's fingerprint is the SimHash of its five-word shingles,
with repeats. A window of a document, as long as an item, is a candidate for that item if their
fingerprints are within ``RADIUS`` bits. The multi-index finds them: with the 64 bits in four
blocks, one block then differs in at most RADIUS // 4 bits, so each item stands in the inverted
lists of all block values within that, a window reads the list of each of its four values, and no item within
the radius is missed. Lists are by item length too. At radius 15 they name 4 % of all pairs of a window and
an item; a window at the least similarity is within it with probability 0.98, at 0.85 and over with 0.997. A candidate is verified by the exact weighted Jaccard similarity of the two multisets of
shingles, which has to be ``MIN_SIMILARITY`` or more.

A window that holds no shingle of any item of its length has similarity zero with all of them, so
only windows around such a shingle are fingerprinted and looked up; that drops nothing. A document
shorter than the item is one window.

The benchmark is broadcast in blocks of about ``BLOCK_CHARS`` characters as arrays, each against
all documents and written before the next is read, so what the driver holds and broadcasts doesn't grow
with it; tasks make the lists of a block themselves. Items of fewer than five words are one
shingle and match where their words occur; items and documents without words match nothing. Null
texts are empty. Repeated rows are rows of their own; repeated item_ids are one item with several
texts. Items without an id are compared like any other and are one item, which counts but isn't listed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.documents import NO_ID
from corvane.llm.tokens import BREAK, LOWER, U64, Prefix, slices, word_bounds, word_hashes
from corvane.tables import written

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
RADIUS = 15
PARTS = 4
BLOCK_CHARS = 1_000_000
_STEP = 1 << 19


def _word_tokens(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = word_bounds(data, borders, BREAK)
    return word_hashes(LOWER[data], start, end), first


def _shingles(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive tokens."""
    out = []
    for at in range(0, max(0, len(tokens) - k + 1), _STEP):
        piece = tokens[at : at + _STEP + k - 1]
        i = np.arange(len(piece) - k + 1)
        out.append(Prefix(piece)(i, i + k))
    return np.concatenate(out) if out else np.zeros(0, U64)


def simhash(hashes: np.ndarray, lo: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the stretches of n hashes from each lo."""
    bits = np.unpackbits(np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits((sums[lo + n] - sums[lo]) * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def _stretches(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the stretches lo..hi, and which stretch each is of."""
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    """Block b of each fingerprint."""
    bits = 64 // PARTS
    return ((prints >> U64(b * bits)) & U64((1 << bits) - 1)).astype(np.int64)


class Items:
    """A block of benchmark items as arrays, with inverted lists by fingerprint block and by shingle."""

    def __init__(self, ids: list[int], texts: list[bytes], radius: int):
        self.radius = radius
        kept, words, grams, counts, prints = [], [], [], [], []
        for item, text in zip(ids, texts, strict=True):
            data = np.frombuffer(text, np.uint8)
            tokens, _ = _word_tokens(data, np.array([0, len(data)]))
            if len(tokens):
                hashes = _shingles(tokens, min(SHINGLE_WORDS, len(tokens)))
                own, n = np.unique(hashes, return_counts=True)
                kept.append(item)
                words.append(len(tokens))
                grams.append(own)
                counts.append(n)
                prints.append(simhash(hashes, np.array([0]), len(hashes))[0])
        self.ids, self.words, self.prints = np.array(kept, np.int64), np.array(words, np.int64), np.array(prints, U64)
        self.first = np.r_[0, np.cumsum([len(x) for x in grams], dtype=np.int64)]
        self.grams, self.counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, counts))
        self.items = {n: np.flatnonzero(self.words == n) for n in sorted(set(words))}
        self._lists = None
        self.lengths = {}  # by shingle size: sorted shingles, and the lengths of the items that hold each
        of_item = np.repeat(self.words, np.diff(self.first))
        for k in sorted({min(SHINGLE_WORDS, n) for n in words}):
            own = np.minimum(of_item, SHINGLE_WORDS) == k
            pairs = np.unique(np.stack([self.grams[own], of_item[own].astype(U64)], axis=1), axis=0)
            keys, first = np.unique(pairs[:, 0], return_index=True)
            self.lengths[k] = keys, np.r_[first, len(pairs)], pairs[:, 1].astype(np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_lists": None}

    def lists(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        """The inverted lists as sorted keys (block, value and length in one number) with an item each, and the number of each length."""
        if self._lists is None:
            bits = 64 // PARTS
            masks = np.flatnonzero(np.bitwise_count(np.arange(1 << bits, dtype=np.uint32)) <= self.radius // PARTS)
            number = {n: i for i, n in enumerate(self.items)}
            own = np.array([number[n] for n in self.words.tolist()], dtype=np.int64)
            keys = [((b << bits | (_block(self.prints, b)[:, None] ^ masks)) * len(number) + own[:, None]).ravel() for b in range(PARTS)]
            items = np.tile(np.repeat(np.arange(len(self.prints), dtype=np.int32), len(masks)), PARTS)
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            self._lists = keys[order], items[order], number
        return self._lists

    def candidates(self, fingerprints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that the lists name and whose fingerprints are within the radius."""
        keys, items, number = self.lists()
        wanted = np.concatenate([(b << (64 // PARTS) | _block(fingerprints, b)) * len(number) + number[length] for b in range(PARTS)])
        lo, hi = np.searchsorted(keys, wanted, side="left"), np.searchsorted(keys, wanted, side="right")
        entry, of = _stretches(lo, hi)
        named = np.unique((of % max(1, len(fingerprints))) * len(self.prints) + items[entry])
        w, i = named // len(self.prints), named % len(self.prints)
        near = np.bitwise_count(fingerprints[w] ^ self.prints[i]) <= self.radius
        return w[near], i[near]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles with an item's."""
        own, n = np.unique(window, return_counts=True)
        grams, counts = (x[self.first[item] : self.first[item + 1]] for x in (self.grams, self.counts))
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        both = np.minimum(n, counts[at])[grams[at] == own].sum()
        return both / (len(window) + counts.sum() - both)


def _found(tokens: np.ndarray, hits: np.ndarray, length: int, items: Items, min_similarity: float) -> dict[int, float]:
    """The highest similarity of each item of a length with a window around the hits, from ``min_similarity`` on."""
    n = min(length, len(tokens))
    k = min(SHINGLE_WORDS, length)
    m = n - k + 1
    if m < 1:
        return {}
    starts = np.unique((hits[:, None] - np.arange(m)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + n <= len(tokens))]
    best: dict[int, float] = {}
    for piece in np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1):
        if not len(piece):
            continue
        base = piece[0]
        hashes = _shingles(tokens[base : piece[-1] + n], k)
        for w, item in zip(*(x.tolist() for x in items.candidates(simhash(hashes, piece - base, m), length)), strict=True):
            at = piece[w] - base
            likeness = items.similarity(hashes[at : at + m], item)
            if likeness >= max(min_similarity, best.get(item, 0.0)):
                best[item] = likeness
    return best


def _search(items: Items, min_similarity: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, found, likeness = [], [], []
            for lo, hi, data, borders in slices(batch.column("text")):
                tokens, first = _word_tokens(data, borders)
                ids = batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                around = defaultdict(list)
                for k, (keys, begins, lengths) in items.lengths.items():
                    hashes = _shingles(tokens, k)
                    if not len(hashes):
                        continue
                    key = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = np.flatnonzero(keys[key] == hashes)
                    row = np.searchsorted(first, hit, side="right") - 1
                    inside = hit + k <= first[row + 1]
                    hit, row = hit[inside], row[inside]
                    entry, of = _stretches(begins[key[hit]], begins[key[hit] + 1])
                    for at, r, n in zip((hit - first[row])[of].tolist(), row[of].tolist(), lengths[entry].tolist(), strict=True):
                        around[r, n].append(at)
                best: dict[tuple[int, int], float] = {}
                for (r, n), hits in around.items():
                    for item, x in _found(tokens[first[r] : first[r + 1]], np.array(hits), n, items, min_similarity).items():
                        best[r, int(items.ids[item])] = max(x, best.get((r, int(items.ids[item])), 0.0))
                for (r, item), x in best.items():
                    docs.append(ids[r])
                    found.append(item)
                    likeness.append(round(x, 6))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64()), pa.array(likeness, pa.float64())], ["doc_id", "item_id", "similarity"])

    return search


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity) of documents (doc_id, text) with a window like an item (item_id, text)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = 1 + chars // BLOCK_CHARS
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = []
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        if own and any(r.text for r in own):
            pairs = read.mapInArrow(_search(Items([r.item_id for r in own], [r.text.encode() for r in own], radius), min_similarity), "doc_id long, item_id long, similarity double")
            found.append(pairs if blocks == 1 else written(pairs, "leaks"))
    if not found:
        return read.where("false").select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.unionAll, found).withColumn("item_id", F.when(F.col("item_id") != NO_ID, F.col("item_id")))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, similarity), one row a document.

    item_ids are the sorted items found, similarity the highest of them (0 without).
    """
    unnamed = F.max(F.col("item_id").isNull().cast("long"))
    by_doc = contaminated_pairs(docs, benchmark).groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), unnamed.alias("unnamed"), F.max("similarity").alias("similarity"))
    joined = docs.select(F.col("doc_id").cast("long")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    n = F.size(ids) + F.coalesce("unnamed", F.lit(0))
    return joined.select("doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
