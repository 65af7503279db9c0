"""Substring dedup on bytes: every byte in a 400-byte string that also starts anywhere else goes.

Suffixes are put into buckets by a sampled prefix (the anchor, see ``repeats``), and one bucket is
resolved at a time. Long ties, suffixes that agree for longer than the anchor, are not compared
byte by byte: cells of 16 and then of 4 neighbouring suffixes are named by hashes of their common
core and of their whole, which stand in for the ranks of a cover sample, and only cells at the edge
of a repeat are opened. The README says how this differs from a suffix array with a difference cover.

Texts are UTF-8 bytes, null is empty, and strings never cross documents. Rows that are repeated
whole are two places. A row's other columns aren't used.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.documents import doc_id
from corvane.llm.repeats import covered, repeated_windows
from corvane.llm.tokens import strings

WINDOW_BYTES = 400
GRAM_BYTES = 33
CELLS = (16, 4)


def _bytes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, borders


def _cut(window: int, digest: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, starts in zip(strings(batch.column("text")), batch.column("starts"), strict=True):
                n, gone, spans = len(text), 0, 0
                if starts.is_valid:
                    cut = covered(n, starts.values.to_numpy(), window)
                    gone = int(cut.sum())
                    spans = int(np.count_nonzero(np.diff(np.r_[False, cut].astype(np.int8)) == 1))
                    text = np.frombuffer(text, np.uint8)[~cut].tobytes()
                n_bytes.append(n)
                n_removed.append(gone)
                n_spans.append(spans)
                kept.append(sha256(text).hexdigest() if digest else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW_BYTES, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes, which may cut a character, or their SHA-256."""
    rows, repeats = repeated_windows(docs, _bytes, window, min(GRAM_BYTES, window), CELLS if window > 2 * CELLS[0] else ())
    joined = rows.join(repeats, ["_d", "_t"], "left").select(doc_id(), "text", "starts")
    return joined.mapInArrow(_cut(window, digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")


def suffix_digests(docs: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return without_repeated_bytes(docs, window, digest=True).withColumnRenamed("kept", "kept_sha256")
