"""Line dedup: lines that many documents share stay only in the document with the largest id.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys
of at least ``min_chars`` code points that are found in at least ``min_docs`` documents lose all
their lines, except in the largest doc_id that holds the key.

Keys travel as 128-bit hashes with document and line number, never as text. How many documents
hold a key is pre-aggregated, so a key that a third of all rows share is not gathered; lines of
frequent keys are then range-partitioned by hash and document (a hot hash spreads over several
ranges), sorted by hash, falling document and position, and streamed: the first document of a
hash keeps its lines, and those of later documents are marked. A hash that a range begins with may
have begun in the range before, which the stream can't see, so the first document of that one hash
is marked as open, and only these few rows look up the largest document of their hash. The result
is one compressed bitmap of kept lines a document instead of text.

A null or empty text is one empty line, which stays. Rows that are repeated whole are one document;
a repeated doc_id with another text counts once where documents are counted, and keeps the lines of
each of its rows alike. Rows with a null doc_id are documents told apart by their texts; they are
smaller than any id, and among themselves in the order of a hash of the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.documents import NO_ID, doc_id, keyed, text_key
from corvane.llm.groups import rejoined
from corvane.llm.tokens import LOWER_BYTES, strings

MIN_CHARS = 40
MIN_DOCS = 5
_STRIP = b" \t\n\x0b\x0c\r"


def _line_keys(min_chars: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, ts = batch.column("_d").to_pylist(), batch.column("_t").to_pylist()
            out: list[tuple] = []
            for d, t, text in zip(ds, ts, strings(batch.column("text")), strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(_STRIP)
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    h = xxhash.xxh3_128_intdigest(key.translate(LOWER_BYTES))
                    out.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), d, t, pos))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return split


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    h, g, d, t, pos = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(d, pa.int64()), pa.array(t, pa.int64()), pa.array(pos, pa.int32())], ["h", "g", "_d", "_t", "pos"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range come by hash and falling document: those after a hash's first document, and, as open, the first document of the first hash."""
    edge = last = first = None  # the range's first hash, the last row's hash, that hash's first document
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, d, u = (np.asarray(batch.column(c)) for c in ("h", "g", "_d", "_u"))
        begins = np.r_[last != (h[0], g[0]), (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        if edge is None:
            edge = (h[0], g[0])
        run = np.cumsum(begins) - 1  # -1: the hash that the last batch ended with
        at = np.flatnonzero(begins)
        heads_d, heads_u = np.r_[d[at], first[0] if first else 0], np.r_[u[at], first[1] if first else 0]
        head_d, head_u = heads_d[run], heads_u[run]
        late = (d != head_d) | (u != head_u)
        open_ = ~late & (h == edge[0]) & (g == edge[1])
        last, first = (h[-1], g[-1]), (head_d[-1], head_u[-1])
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(open_)], [*batch.schema.names, "open"])
        yield out.filter(pa.array(late | open_))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[gone or []] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["_d", "_t", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_d, _t, n_lines, n_dropped, keep) for each distinct document row; see ``documents.keyed``."""
    rows = keyed(docs)
    lines = rows.mapInArrow(_line_keys(min_chars), "h long, g long, _d long, _t long, pos int").withColumn("_u", F.when(F.col("_d") == NO_ID, F.col("_t")).otherwise(0))
    document = F.struct("_d", "_u")
    holders = lines.groupBy("h", "g").agg(F.countDistinct(document).alias("n"), F.max(document).alias("holder")).where(F.col("n") >= min_docs).select("h", "g", "holder")
    shared = rejoined(lines, holders.select("h", "g"), "h", "g")
    order = ["h", "g", F.col("_d").desc(), F.col("_u").desc(), "pos"]
    streamed = shared.select("h", "g", "_d", "_u", "_t", "pos").repartitionByRange(*order[:4]).sortWithinPartitions(*order).mapInArrow(_later, "h long, g long, _d long, _u long, _t long, pos int, open boolean")
    opened = rejoined(streamed.where("open"), holders, "h", "g").where(document != F.col("holder"))
    late = streamed.where("not open").select("_d", "_t", "pos").unionAll(opened.select("_d", "_t", "pos"))
    gone = late.groupBy("_d", "_t").agg(F.array_distinct(F.collect_list("pos")).alias("gone"))
    text = F.coalesce("text", F.lit(""))
    counted = rows.select("_d", "_t", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")).dropDuplicates(["_d", "_t"])
    return counted.join(gone, ["_d", "_t"], "left").mapInArrow(_bitmaps, "_d long, _t long, n_lines long, n_dropped long, keep binary")


def kept_bits(keep: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n).astype(bool)


def _kept(text: bytes, keep: bytes, n_lines: int, n_dropped: int) -> bytes:
    if not n_dropped:
        return text
    return b"\n".join(line for line, k in zip(text.split(b"\n"), kept_bits(keep, n_lines).tolist(), strict=True) if k)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, keep = (batch.column(c).to_pylist() for c in ("n_lines", "n_dropped", "keep"))
        digests = [sha256(_kept(*x)).hexdigest() for x in zip(strings(batch.column("text")), keep, n, gone, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(digests)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), a row a document."""
    joined = keyed(docs).join(keep_bitmaps(docs, min_chars, min_docs), ["_d", "_t"])
    return joined.select(doc_id(), "text", "n_lines", "n_dropped", "keep").mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with only their kept lines as text; a document of which no line is left has an empty text."""
    bitmaps = keep_bitmaps(docs, min_chars, min_docs).where("n_dropped > 0")
    columns = docs.columns
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, keep = (batch.column(c).to_pylist() for c in ("_n", "_gone", "_keep"))
            out = batch.column("row").flatten()
            texts = [_kept(x[0], *x[1:]).decode() if x[3] else None for x in zip(strings(out[at]), keep, n, gone, strict=True)]
            old = out[at].to_pylist()
            out[at] = pa.array([o if x is None else x for o, x in zip(old, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(out, columns)

    text = F.col("text").cast("string")
    row = docs.withColumn("text", text)
    keys = {"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_t": text_key(text)}
    placed = row.select(F.struct(*[f"`{c}`" for c in columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])  # columns of any name go through in a struct
    joined = placed.join(bitmaps.select("_d", "_t", F.col("n_lines").alias("_n"), F.col("n_dropped").alias("_gone"), F.col("keep").alias("_keep")), ["_d", "_t"], "left")
    return joined.select("row", "_n", "_gone", "_keep").mapInArrow(cut, row.schema)
