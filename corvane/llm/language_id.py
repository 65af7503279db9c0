"""Language identification by prediction by partial matching on bytes.

Each language has a context tree of the bytes (A-Z lower-cased, padded with blanks at the start)
that follow each context of up to three bytes in its training texts. A byte's code length is that
of method C: seen n times among T followers with D different ones in the longest context, it has
probability n / (T + D); an escape has D / (T + D) and goes on to the next shorter context, down
to 1/256 for any byte. Statistics are frozen while scoring, so a text's code length in a language
is the sum over its bytes, whatever their order of arrival; the language with the shortest code
is predicted, and the score is its share of the probabilities.

Trees are counted by Spark on a bounded sample of each language, ``train_docs`` whole documents by
a hash of their ids, and only counts of four-byte strings reach the driver. Scoring looks up
whole texts in vectorised tables.

A text that is null or has no letter is ``und`` with score 0; so is any text when nothing could be
learned. A null lang is not learned from. Equal code lengths go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import LOWER, slices
from corvane.llm.toxicity import held_out

ORDER = 3
TRAIN_DOCS = 1500


def _grams(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes up to each byte, as an integer, row by row, and the rows' borders."""
    n = len(borders) - 1
    text = np.full(len(data) + ORDER * n, 32, dtype=np.uint32)
    at = np.arange(len(data)) + ORDER * np.repeat(np.arange(1, n + 1), np.diff(borders))
    text[at] = LOWER[data]
    return (text[at - 3] << 24) | (text[at - 2] << 16) | (text[at - 1] << 8) | text[at], borders


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            for _, _, data, borders in slices(batch.column("text").filter(pa.array(langs == lang))):
                gram, n = np.unique(_grams(data, borders)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Places:
    """An open-addressing table of 32-bit integers, four times as large as what it holds."""

    def __init__(self, known: np.ndarray):
        self._bits = max(4, int(4 * len(known) - 1).bit_length())
        self._keys, self._place = np.zeros(1 << self._bits, np.uint32), np.zeros(1 << self._bits, np.int32)
        open_ = np.arange(len(known))
        at, self._probes = self._slot(known.astype(np.uint32)), 0
        while len(open_):
            self._probes += 1
            free = np.flatnonzero(self._place[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            one = free[one]
            self._keys[at[one]], self._place[at[one]] = known[open_[one]], open_[one] + 1
            left = np.ones(len(open_), bool)
            left[one] = False
            open_, at = open_[left], (at[left] + 1) & ((1 << self._bits) - 1)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - self._bits)).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """1 + the place of each integer among the known ones, 0 for others."""
        x = x.astype(np.uint32)
        at = self._slot(x)
        out = np.where(self._keys[at] == x, self._place[at], 0)
        open_ = np.flatnonzero((out == 0) & (self._place[at] != 0))
        for step in range(1, self._probes):
            if not len(open_):
                break
            own = (at[open_] + step) & ((1 << self._bits) - 1)
            hit = self._keys[own] == x[open_]
            out[open_[hit]] = self._place[own[hit]]
            open_ = open_[~hit & (self._place[own] != 0)]
        return out


class Model:
    """Frozen context trees of several languages."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs = langs
        self._tables = [[self._order(gram[lang == i] & ((1 << (8 * (o + 1))) - 1), n[lang == i]) for o in range(ORDER + 1)] for i in range(len(langs))]
        self._known = np.unique(gram)
        self._costs = np.concatenate([np.zeros((len(langs), 1)), self.costs(self._known)], axis=1).astype(np.float32)
        self._places: Places | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_places": None}  # tasks make their own

    @staticmethod
    def _order(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of one order: strings and their counts; contexts, their totals and numbers of different followers."""
        seen, where = np.unique(gram, return_inverse=True)
        count = np.bincount(where, n, minlength=len(seen))
        context, where = np.unique(seen >> 8, return_inverse=True)
        return seen, count, context, np.bincount(where, count, minlength=len(context)), np.bincount(where, minlength=len(context))

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Code length in bits of the last byte of each four-byte string, a row a language."""
        out = np.zeros((len(self.langs), len(gram)))
        for row, orders in zip(out, self._tables, strict=True):
            open_ = np.arange(len(gram))
            for o in range(ORDER, -1, -1):
                seen, count, context, total, different = orders[o]
                own = gram[open_] & ((1 << (8 * (o + 1))) - 1)
                at = np.minimum(np.searchsorted(context, own >> 8), max(0, len(context) - 1))
                known = context[at] == own >> 8 if len(context) else np.zeros(len(own), bool)
                hit_at = np.minimum(np.searchsorted(seen, own), max(0, len(seen) - 1))
                hit = seen[hit_at] == own if len(seen) else np.zeros(len(own), bool)
                row[open_[hit]] -= np.log2(count[hit_at[hit]] / (total[at[hit]] + different[at[hit]]))
                escaped = known & ~hit
                row[open_[escaped]] -= np.log2(different[at[escaped]] / (total[at[escaped]] + different[at[escaped]]))
                open_ = open_[~hit]
            row[open_] += 8
        return out

    def code_lengths(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        gram, borders = _grams(data, borders)
        self._places = self._places or Places(self._known)
        index = self._places(gram)
        missing = np.flatnonzero(index == 0)
        new, where = np.unique(gram[missing].astype(np.int64), return_inverse=True)
        new_costs = self.costs(new)
        out = np.zeros((len(self.langs), len(borders) - 1))
        for i in range(len(self.langs)):
            cost = self._costs[i][index]
            cost[missing] = new_costs[i][where]
            sums = np.r_[0.0, np.cumsum(cost, dtype=np.float64)]
            out[i] = sums[borders[1:]] - sums[borders[:-1]]
        return out.T


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Counts context trees on documents that aren't held out and have a language."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    sizes = {r.lang: r.n for r in known.where("text is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, train_docs / n))) for k, n in sorted(sizes.items())])
    sample = known.where(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    got = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    langs = sorted(set(got["lang"].to_pylist()))
    code = np.searchsorted(langs, got["lang"].to_pylist())
    return Model(langs, got["gram"].to_numpy(), code, got["n"].to_numpy())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for documents (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for _, _, data, borders in slices(batch.column("text")):
                if model is None:
                    names += ["und"] * (len(borders) - 1)
                    scores += [0.0] * (len(borders) - 1)
                    continue
                bits = np.round(model.code_lengths(data, borders), 4)
                best = bits.argmin(axis=1)
                more = bits - bits.min(axis=1, keepdims=True)
                scores += np.round(1 / np.exp2(-np.minimum(more, 1000)).sum(axis=1), 6).tolist()
                names += [model.langs[i] for i in best]
            spoken = batch.column("spoken").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x if s else "und" for x, s in zip(names, spoken, strict=True)], pa.string()), pa.array([x if s else 0.0 for x, s in zip(scores, spoken, strict=True)], pa.float64())], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    ready = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    return ready.mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_predictions(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    return predict(docs, fit(docs, train_docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
