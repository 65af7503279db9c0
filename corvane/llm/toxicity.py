"""Toxicity by a bag of subword embeddings, averaged into a linear softmax.

A word, with A-Z lower-cased, is the mean of the embeddings of its character n-grams (3 to 5
bytes, with a mark at either end, hashed into ``BUCKETS``); a document is the mean of its different
words, weighted by 1 + ln of how often each occurs and with ``NEUTRAL`` words of zero added, so
that neither endless repeats nor very short texts stand out; and a softmax over two classes tells
toxic from not. Embeddings and softmax are trained together
in numpy, in one task, on a bounded sample of labelled rows: ``toxic_docs`` and ``other_docs``
rows in the order of a hash of their ids, of which whole documents are taken in that order as
long as they have at most ``max_entries`` (n-gram, weight) entries of 6 bytes in all; one that
would go beyond is left out. Spark writes the sample's entries to a table, and one task reads
that batch by batch into two flat arrays and trains; the driver gets the model alone. The share of toxic rows among all labels corrects the
bias for the sample's. Unseen misspellings and inflections share n-grams with what was seen.

Averaging and softmax are linear in the words, so a trained model is one number a bucket, and
scoring whole texts is vectorised over the bytes of a slice.

Null and empty texts get the score of the bias alone. Labels that are null are left out; a doc_id
with several labels is toxic if one says so, and one with several texts is learned from in one of
them. Without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import LOWER, SPACE, U64, mix, slices, strings, word_bounds, word_hashes
from corvane.tables import Table

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
DIM = 4
NEUTRAL = 20
GAIN = 100.0  #: a toxic word is about one in fifty, so means are scaled up before the softmax
TOXIC_DOCS, OTHER_DOCS = 2000, 4000
MAX_ENTRIES = 16_000_000
SAMPLE_PARTS = 24
THRESHOLD = 0.3
EPOCHS, LEAST_STEPS = 5, 480
BATCH = 64
DECAY = 1e-3


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _padded(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank before every row and after the last, all blanks alike, and rows' borders."""
    n = len(borders) - 1
    out = np.full(len(data) + n + 1, 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(borders))] = np.where(SPACE[data], 32, LOWER[data])
    return out, borders + np.arange(n + 1)


def _grams(text: np.ndarray, size: int) -> np.ndarray:
    packed = np.zeros(len(text) - size + 1, dtype=U64) if len(text) >= size else np.zeros(0, U64)
    for i in range(size if len(packed) else 0):
        packed |= text[i : i + len(packed)].astype(U64) << U64(8 * i)
    return (mix(packed + (U64(size) << U64(56))) & U64(BUCKETS - 1)).astype(np.int32)


def _words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Padded bytes; starts and ends of each row's different words; their rows and weights."""
    text, edges = _padded(data, borders)
    start, end, first = word_bounds(text, edges)
    row = np.repeat(np.arange(len(borders) - 1), np.diff(first))
    own = mix(word_hashes(text, start, end) ^ mix(row.astype(U64) + U64(1)))
    _, at, times = np.unique(own, return_index=True, return_counts=True)
    order = np.argsort(at)
    at = at[order]
    return text, start[at], end[at], row[at], 1 + np.log(times[order])


def word_values(text: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The mean bucket value of each word's n-grams."""
    total, count = np.zeros(len(start)), np.zeros(len(start))
    for size in SIZES:
        sums = np.r_[0.0, np.cumsum(value[_grams(text, size)], dtype=np.float64)]
        n = np.maximum(0, end - start + 3 - size)
        lo = np.minimum(start - 1, len(sums) - 1)
        total += np.where(n > 0, sums[np.minimum(lo + n, len(sums) - 1)] - sums[lo], 0)
        count += n
    return total / np.maximum(count, 1)


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's buckets and the weight of each in the document's mean."""
    text, start, end, _, weight = _words(data, np.array([0, len(data)]))
    counts = [np.maximum(0, end - start + 3 - size) for size in SIZES]
    per_gram = weight / np.maximum(1, sum(counts)) / (weight.sum() + NEUTRAL)
    ids, shares = [], []
    for size, n in zip(SIZES, counts, strict=True):
        word = np.repeat(np.arange(len(start)), n)
        ids.append(_grams(text, size)[(start - 1)[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)])
        shares.append(per_gram[word])
    seen, where = np.unique(np.concatenate(ids), return_inverse=True)
    return seen.astype(np.int32), np.bincount(where, np.concatenate(shares), minlength=len(seen)).astype(np.float32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(strings(batch.column("text"))):
            ids, weights = features(np.frombuffer(text, np.uint8))
            own = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("toxic"), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([(weights * np.float32(GAIN)).astype(np.float16).tobytes()], pa.binary())], ["doc_id", "toxic", "entries", "ids", "weights"])


def train(ids: np.ndarray, weights: np.ndarray, first: np.ndarray, toxic: np.ndarray, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): a document's log odds are the bias and its weighted values.

    Document i has the buckets ids[first[i]:first[i + 1]] with their weights,
    which are GAIN times their shares. Embeddings learn by Adagrad with decay, the softmax by Adam. Buckets of one document only are left out.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.01, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    known = np.bincount(ids, minlength=BUCKETS) > 1
    order = rng.permutation(len(toxic))
    batches = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
    squares = np.zeros_like(emb)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (out, bias)]
    place = np.zeros(BUCKETS, dtype=np.int32)
    step = 0
    for _ in range(max(EPOCHS, LEAST_STEPS // max(1, len(batches)))):
        for at in rng.permutation(len(batches)):
            own = [(i, known[ids[first[i] : first[i + 1]]]) for i in batches[at].tolist()]
            own = [(i, keep) for i, keep in own if keep.any()]
            if not own:
                continue
            bucket = np.concatenate([ids[first[i] : first[i + 1]][keep] for i, keep in own])
            weight = np.concatenate([weights[first[i] : first[i + 1]][keep] for i, keep in own]).astype(np.float32)
            starts = np.r_[0, np.cumsum([k.sum() for _, k in own])[:-1]]
            y = toxic[[i for i, _ in own]]
            in_batch = np.zeros(BUCKETS, dtype=bool)
            in_batch[bucket] = True
            used = np.flatnonzero(in_batch)
            place[used] = np.arange(len(used))
            where = place[bucket]
            own_emb = emb[used].T.copy()
            hidden = np.stack([np.add.reduceat(e[where] * weight, starts) for e in own_emb], axis=1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            sizes = np.diff(np.r_[starts, len(weight)])
            grad = np.stack([np.bincount(where, np.repeat(b, sizes) * weight, minlength=len(used)) for b in out @ p.T], axis=1).astype(np.float32)
            squares[used] += grad * grad
            emb[used] = (emb[used] - 0.02 * grad / (np.sqrt(squares[used]) + 1e-8)) * np.float32(1 - DECAY)
            step += 1
            for x, g, (m, v) in zip((out, bias), (hidden.T @ p, p.sum(axis=0)), moments, strict=True):
                m[:] = 0.9 * m + 0.1 * g
                v[:] = 0.99 * v + 0.01 * g * g
                x -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    emb[~known] = 0
    share = toxic.mean()
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return (GAIN * (emb @ (out[:, 1] - out[:, 0]))).astype(np.float64), float(bias[1] - bias[0] + shift)


def fit(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, other_docs: int = OTHER_DOCS, max_entries: int = MAX_ENTRIES) -> tuple[np.ndarray, float]:
    """Trains on labelled documents that aren't held out; see ``train``."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_l"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("_l"))).groupBy("_l").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return np.zeros(BUCKETS), -np.inf
    order = [F.xxhash64(F.lit(5), "_l"), F.col("_l")]
    sample = known.where("toxic = 1").orderBy(*order).limit(toxic_docs).unionAll(known.where("toxic = 0").orderBy(*order).limit(other_docs))
    text = F.col("text").cast("string")
    found = docs.select(F.col("doc_id").cast("long"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("one")).join(sample, F.col("doc_id") == F.col("_l"))
    rows = found.groupBy("doc_id", "toxic").agg(F.min("one")["text"].alias("text")).repartition(SAMPLE_PARTS, "doc_id")
    table = Table(rows.mapInArrow(_features, "doc_id long, toxic int, entries long, ids binary, weights binary"), "toxicity_sample")
    taken = _taken(table.df, max_entries)
    if len({t for _, t, _ in taken}) < 2:
        table.drop()
        return np.zeros(BUCKETS), -np.inf
    model = table.df.select("doc_id", "ids", "weights").coalesce(1).mapInArrow(_trained(taken, counts[1] / (counts[0] + counts[1])), "value binary, bias double").first()
    table.drop()
    return np.frombuffer(model.value), model.bias


def _taken(sample: DataFrame, max_entries: int) -> list[tuple[int, int, int]]:
    """(doc_id, class, entries) of the sample's documents that are learned from, in the order of doc_id; as many in the order of a hash as have room."""
    taken, left = [], max_entries
    for r in sample.select("doc_id", "toxic", "entries").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").collect():
        if r.entries <= left:
            taken.append((r.doc_id, r.toxic, r.entries))
            left -= r.entries
    return sorted(taken)


def _trained(taken: list[tuple[int, int, int]], prior: float):
    """Training in one task, which holds the bounded sample; the driver holds only what was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.r_[0, np.cumsum([n for _, _, n in taken], dtype=np.int64)]
        place = {i: k for k, (i, _, _) in enumerate(taken)}
        ids, weights = np.zeros(first[-1], np.int32), np.zeros(first[-1], np.float16)
        for batch in batches:
            for i, own_ids, own_weights in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("weights"), strict=True):
                if i in place:
                    own = slice(first[place[i]], first[place[i] + 1])
                    ids[own], weights[own] = np.frombuffer(own_ids.as_buffer(), np.int32), np.frombuffer(own_weights.as_buffer(), np.float16)
        value, bias = train(ids, weights, first, np.array([t for _, t, _ in taken], dtype=np.int64), prior)
        yield pa.RecordBatch.from_arrays([pa.array([value.tobytes()], pa.binary()), pa.array([bias])], ["value", "bias"])

    return run


def log_odds(data: np.ndarray, borders: np.ndarray, value: np.ndarray, bias: float) -> np.ndarray:
    text, start, end, row, weight = _words(data, borders)
    n = len(borders) - 1
    return bias + np.bincount(row, word_values(text, start, end, value) * weight, minlength=n) / (np.bincount(row, weight, minlength=n) + NEUTRAL)


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of the documents (doc_id, text, ..; all by default) and ``toxicity``, 0 to 1."""
    value, bias = model
    columns = [c for c in keep or docs.columns if c != "toxicity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [log_odds(data, borders, value, bias) for _, _, data, borders in slices(batch.column("_text"))]
            odds = np.concatenate(odds) if odds else np.zeros(0)
            scores = np.round(1 / (1 + np.exp(-np.clip(odds, -700, 700))), 6)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores)], [*columns, "toxicity"])

    ready = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    return ready.mapInArrow(run, ready.drop("_text").withColumn("toxicity", F.lit(0.0)).schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
