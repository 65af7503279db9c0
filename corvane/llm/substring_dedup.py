"""Substring dedup on words: every word in a window that also starts anywhere else goes.

The method named is a relative Lempel-Ziv parse, which factors each document greedily against every
block of the reference. The README gives the measured cost of that and why it isn't what runs. What
runs keeps its outcome: stretches that the rest of the corpus holds are found as a whole through
sampled eight-word grams, and where they end, windows across the boundary are compared one by one.
``repeats`` has the details and why the result is exact.

A word is ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if it is covered by a window of
``window`` words of one document whose word sequence also starts anywhere else, the same document
included; all windows are judged on the input. Null and empty texts have no words. Rows that are
repeated whole are two places. A row's other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.documents import doc_id
from corvane.llm.repeats import covered, repeated_windows
from corvane.llm.tokens import strings, word_bounds, word_hashes

WINDOW_WORDS = 35
GRAM_WORDS = 8
CELLS = (4,)


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = word_bounds(data, borders)
    return word_hashes(data, start, end), first


def _cut(window: int, digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(strings(batch.column("text")), batch.column("starts"), strict=True):
                words = text.split()
                n, gone = len(words), 0
                if starts.is_valid:
                    keep = ~covered(n, starts.values.to_numpy(), window)
                    gone = int(n - keep.sum())
                    words = compress(words, keep.tolist())
                left = b" ".join(words)
                n_words.append(n)
                n_removed.append(gone)
                kept.append(sha256(left).hexdigest() if digest else left.decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return cut


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or the SHA-256 of that."""
    rows, repeats = repeated_windows(docs, _words, window, min(GRAM_WORDS, window), CELLS if window > 2 * CELLS[0] else ())
    joined = rows.join(repeats, ["_d", "_t"], "left").select(doc_id(), "text", "starts")
    return joined.mapInArrow(_cut(window, digest), "doc_id long, n_words long, n_removed long, kept string")


def substring_digests(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return without_repeats(docs, window, digest=True).withColumnRenamed("kept", "kept_sha256")
