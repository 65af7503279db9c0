"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, components.

Vectors that point within ``acos(min_cosine)`` of each other agree on one random hyperplane's
sign with probability 1 - angle/pi. A table's bucket is the signs of ``bits`` hyperplanes, and
there are as many tables as it takes for a pair at the threshold to meet in one of them with
probability ``recall``. The signs of all tables together are a vector's sketch. Buckets first hold
keys and sketches only, of a few bytes: a vector stays in a bucket if the sketch of another one is
within the mean and six standard deviations of the distance at the threshold. Most vectors have no
such neighbour and go no further; those that stay meet again in the same buckets with their
components. Pairs are then verified by their cosine in double precision, in blocks of a matrix
product, and a pair is counted in the first table in which it meets, so link counts need no list
of pairs. Equal vectors are collapsed to one weighted vector first, and a hot bucket is cut into
pairs of blocks (``groups.paired_blocks``).

Vectors that are null, empty, all zero, or that hold null or non-finite components link with
nothing; vectors of different lengths neither. Rows with the same vector are copies of each other,
whatever their ids, and a repeated vec_id with another vector is another vector. A null vec_id has
its links counted and a null component; a component of null ids only has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.groups import paired_blocks, rejoined, runs
from corvane.tables import written

MIN_COSINE = 0.95
RECALL = 0.999
SEED = 20


def plan(n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table, so that buckets of unrelated vectors stay near 16 rows, and the tables for the recall."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1))) - 4))
    meet = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, unit): unit is the vector as doubles of length one, null where it links with nothing."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, units = [], []
            for row in batch.column("embedding").to_pylist():
                x = np.array([np.nan if v is None else v for v in row or []], dtype=np.float64)
                top = np.abs(x).max() if len(x) else 0.0
                fine = np.isfinite(top) and top > 0
                if fine:
                    x = x / top
                    x = x / np.sqrt(np.dot(x, x)) + 0.0
                dims.append(len(x))
                units.append(x.tobytes() if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "dim", "unit"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(scale, "vec_id long, dim int, unit binary")


def _within(x: np.ndarray, y: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(x @ y.T >= min_cosine)


def sketch_radius(bits: int, min_cosine: float = MIN_COSINE) -> int:
    """Bits in which sketches of a pair at the threshold differ at most, at six standard deviations."""
    apart = math.acos(min_cosine) / math.pi
    return math.ceil(bits * apart + 6 * math.sqrt(bits * apart * (1 - apart)))


def sketch(x: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature of each table, all signs packed) of each row."""
    signs = (x @ planes(x.shape[1], bits, tables) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64)), np.packbits(signs.reshape(len(x), -1), axis=1)


def table_signatures(column: pa.ChunkedArray, bits: int, tables: int) -> np.ndarray:
    """The signature of each table out of sketches."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=bits * tables).reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _words(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Sketches of ``width`` bytes, padded to 64-bit words."""
    out = np.zeros((len(column), -(-width // 8) * 8), np.uint8)
    out[:, :width] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    return out.view(np.uint64)


def _neighboured(words: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of a part have another sketch within the radius, among those they are compared with."""
    out = np.zeros(len(words), bool)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for lo in range(0, len(left), 256):
        i = left[lo : lo + 256]
        near = sum(np.bitwise_count(words[i, w][:, None] ^ words[right, w][None, :]).astype(np.int32) for w in range(words.shape[1])) <= radius
        if side[0] == 2:
            near &= i[:, None] != right[None, :]
        out[i] |= near.any(axis=1)
        out[right] |= near.any(axis=0)
    return out


def links(classes: DataFrame, n: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> DataFrame:
    """(rep, n_links, root) rows to be summed by rep; rep and root are connected."""
    bits, tables = plan(n, min_cosine, recall)
    if tables > 255:
        raise ValueError(f"{tables} tables are needed for a recall of {recall} at cosine {min_cosine}; there is room for 255")
    width, radius = -(-bits * tables // 8), sketch_radius(bits * tables, min_cosine)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in np.unique(batch.column("dim")).tolist():
                if dim >= 1 << 15:
                    raise ValueError(f"a vector has {dim} components; there is room for {(1 << 15) - 1}")
                own = batch.filter(pa.array(np.asarray(batch.column("dim")) == dim))
                for at in range(0, own.num_rows, 2048):
                    piece = own.slice(at, 2048)
                    sigs, packed = sketch(_matrix(piece.column("unit"), dim), bits, tables)
                    keys = sigs + (np.arange(tables, dtype=np.int64) << 40) + (dim << 48)
                    yield pa.RecordBatch.from_arrays([piece.column("rep"), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["rep", "sketch", "keys"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part, side, words = table["part"].to_numpy(), table["side"].to_numpy(), _words(table["sketch"], width)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sizes = np.diff(np.r_[first, len(part)])
            kept = [at + np.flatnonzero(_neighboured(words[at : at + size], side[at : at + size], radius)) for at, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True)]
            yield from table.take(np.concatenate([np.zeros(0, np.int64), *kept])).to_batches()

    keyed = classes.mapInArrow(sign, "rep long, sketch binary, keys array<long>")
    dealt = paired_blocks(keyed.select("rep", "sketch", F.explode("keys").alias("key")), "key", "rep").select("part", "side", "rep", "key", "sketch")
    near = written(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(stay, "part long, side byte, rep long, key long, sketch binary"), "near")
    whole = near.join(classes.select(F.col("rep").alias("_rep"), "weight", "dim", "unit"), F.col("rep") == F.col("_rep"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part", 4096):
            part = table["part"].to_numpy()
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sizes = np.diff(np.r_[first, len(part)])
            for at, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
                own = table.slice(at, size)
                rep, weight, side = (own[c].to_numpy() for c in ("rep", "weight", "side"))
                x, t = _matrix(own["unit"], own["dim"][0].as_py()), (own["key"][0].as_py() >> 40) & 0xFF
                count, root = np.zeros(size, np.int64), np.arange(size)
                left = np.flatnonzero(side != 1)
                right = np.flatnonzero(side != 0)
                for lo in range(0, len(left), 512):
                    i = left[lo : lo + 512]
                    u, v = _within(x[i], x[right], min_cosine)
                    u, v = i[u], right[v]
                    keep = (u < v) if side[0] == 2 else u >= 0
                    u, v = u[keep], v[keep]
                    if not len(u):
                        continue
                    seen = np.unique(np.r_[u, v])
                    sigs = table_signatures(own["sketch"].take(pa.array(seen)), bits, tables)
                    su, sv = np.searchsorted(seen, u), np.searchsorted(seen, v)
                    new = np.ones(len(u), bool)
                    for earlier in range(t):
                        new &= sigs[su, earlier] != sigs[sv, earlier]
                    u, v = u[new], v[new]
                    np.add.at(count, u, weight[v])
                    np.add.at(count, v, weight[u])
                    while True:
                        low = np.minimum(root[u], root[v])
                        before = root.copy()
                        np.minimum.at(root, root[u], low)
                        np.minimum.at(root, root[v], low)
                        root = root[root]
                        if (before == root).all():
                            break
                hit = np.flatnonzero(count)
                if len(hit):
                    while (root[root] != root).any():
                        root = root[root]
                    yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(count[hit]), pa.array(rep[root[hit]])], ["rep", "n_links", "root"])

    placed = whole.select("part", "side", "rep", "weight", "dim", "unit", "key", "sketch").repartition("part").sortWithinPartitions("part")
    return placed.mapInArrow(verify, "rep long, n_links long, root long")


def embedding_near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors (vec_id, embedding, ...); see the module."""
    units = written(unit_vectors(vectors), "units")
    rep = F.xxhash64("unit", "dim").alias("rep")
    classes = written(units.where("unit is not null").groupBy("unit", "dim").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).select("unit", "dim", "least", "weight", rep), "vectors")
    found = written(links(classes, classes.count(), min_cosine, recall), "links")
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    named = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = classes.join(counts, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
    by_class = written(joined.select("rep", "least", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "linked")
    smallest = rejoined(by_class, by_class.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    plain = units.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rejoined(units.where("unit is not null").select("vec_id", rep), smallest.select("rep", "n_links", "component_id"), "rep")
    out = linked.select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id")).unionByName(plain)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
