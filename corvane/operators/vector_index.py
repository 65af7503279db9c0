"""An approximate vector index: lists around trained centroids, short codes in them, exact cosines at the end.

Building trains a coarse quantiser (``lists`` centroids) and a product quantiser (``parts`` codebooks
of the residuals) by Lloyd's rounds in Spark: each task sends the sums and counts of its rows, so
what the driver holds is centroids and codebooks and no vectors. Training reads a sample of at most ``TRAIN_ROWS`` vectors
in the order of a hash; every vector is then encoded and written to a table in folders by list, with its code and itself.

A search reads the codes of the lists nearest to its query, estimates cosines from a table of inner
products by codebook, keeps the ``depth`` best estimates of each query, reads only these vectors and ranks
them by exact cosine. How many lists and how deep is measured when the index is built: vectors of a
sample are searched for exactly and by codes, and the least cost that finds ``recall`` of their neighbours is kept.

Vectors that are null, without length, not finite, or of another dimension than most have no place in
the index and queries like that find nothing, and so have rows without an id. Repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.retrieval import QUERY_BLOCK, top
from corvane.tables import Table, fresh_path, written

TRAIN_ROWS = 65_536
TUNE_QUERIES = 128
TUNE_NEIGHBOURS = 10
MAX_LISTS = 4096
WORDS = 256
ROUNDS = 8
RECALL = 0.95


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """The vectors of a batch, of length one each."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(rows: DataFrame, name: str, dim: int | None = None) -> DataFrame:
    """(id, v) of rows (id, embedding) that have a direction, and the given dimension."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col(name).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists(v, lambda x: F.abs(x) > 1e-150)
    read = rows.where(ok).select(F.col(name).cast("long").alias(name), v.alias("v"))
    return read if dim is None else read.where(F.size("v") == dim)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each row the centre at the least distance."""
    size, step = (centres * centres).sum(axis=1)[None, :], max(1, (1 << 21) // len(centres))
    return np.concatenate([np.argmin(size - 2 * (x[at : at + step] @ centres.T), axis=1) for at in range(0, len(x), step)])


def _rounds(sample: DataFrame, cells: np.ndarray, place, rounds: int) -> np.ndarray:
    """Lloyd's rounds: ``cells`` (groups, k, width) move to the means of what ``place`` puts in them; empty ones stay."""
    groups, k, width = cells.shape
    for _ in range(rounds):
        now = cells

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((groups, k, width)), np.zeros((groups, k))
            for batch in batches:
                if batch.num_rows:
                    for g, (rows, at) in enumerate(place(_matrix(batch.column("v"), batch.num_rows), now)):  # noqa: B023
                        np.add.at(total[g], at, rows)
                        count[g] += np.bincount(at, minlength=k)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["total", "count"])

        found = sample.mapInArrow(sums, "total binary, count binary").collect()  # a row a task, of the size of the centroids
        total = sum(np.frombuffer(r.total).reshape(groups, k, width) for r in found)
        count = sum(np.frombuffer(r["count"]).reshape(groups, k, 1) for r in found)
        cells = np.where(count > 0, total / np.maximum(count, 1), now)
    return cells


@dataclass
class VectorIndex:
    """table (list, item_id, code, v) in folders by list; centroids, codebooks, and how wide to search."""

    table: DataFrame
    centres: np.ndarray
    books: np.ndarray
    rows: int
    probes: int = 1
    depth: int = 100

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def _blocks(self, queries: DataFrame) -> Iterator[list]:
        asked = usable(queries, "query_id", self.dim)
        blocks = -(-asked.count() // QUERY_BLOCK)
        for b in range(blocks):
            yield asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).orderBy("query_id").collect()

    def candidates(self, rows: list, probes: int, depth: int) -> DataFrame:
        """(query_id, list, item_id, estimate, rank): the best estimates of a block of queries in their nearest lists."""
        ids, q = np.array([r.query_id for r in rows], dtype=np.int64), _unit_rows(rows)
        near = np.argsort(-(q @ self.centres.T) * 2 + (self.centres * self.centres).sum(axis=1)[None, :], axis=1, kind="stable")[:, :probes]
        asking: dict[int, list[int]] = {}
        for i, own in enumerate(near.tolist()):
            for c in own:
                asking.setdefault(c, []).append(i)
        books, centres = self.books, self.centres
        parts, _, width = books.shape

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            products = np.einsum("qpw,pkw->qpk", q.reshape(len(q), parts, width), books).astype(np.float32)
            base = q @ centres.T
            for batch in batches:
                if not batch.num_rows:
                    continue
                lists, items = np.asarray(batch.column("list")), np.asarray(batch.column("item_id"))
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(items), parts)
                out = []
                for c in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == c)
                    for i in asking.get(c, ()):
                        guess = base[i, c] + products[i][np.arange(parts)[:, None], codes[at].T].sum(axis=0)
                        best = np.arange(len(at)) if len(at) <= depth else np.argpartition(-guess, depth - 1)[:depth]
                        out.append((np.full(len(best), ids[i]), np.full(len(best), c), items[at[best]], guess[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "list", "item_id", "estimate"])

        read = self.table.where(F.col("list").isin(sorted(asking))).select("list", "item_id", "code")
        return top(read.mapInArrow(estimate, "query_id long, list int, item_id long, estimate double"), depth, F.desc("estimate"), F.col("item_id"))

    def _ranked(self, rows: list, k: int, probes: int, depth: int, skip_self: bool) -> DataFrame:
        at, q = {r.query_id: i for i, r in enumerate(rows)}, _unit_rows(rows)
        # a row of the table is known by list and id; of rows with one id each comes in as often as it is a candidate, and once is enough
        found = self.candidates(rows, probes, depth).select("query_id", "list", "item_id").distinct()
        if skip_self:
            found = found.where("query_id <> item_id")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = q[[at[i] for i in batch.column("query_id").to_pylist()]]
                    cos = np.round((own * _matrix(batch.column("v"), batch.num_rows)).sum(axis=1), 6)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("item_id"), pa.array(cos)], ["query_id", "item_id", "cosine"])

        joined = self.table.select("list", "item_id", "v").join(found, ["list", "item_id"])
        return top(joined.select("query_id", "item_id", "v").mapInArrow(exact, "query_id long, item_id long, cosine double"), k, F.desc("cosine"), F.col("item_id"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, depth: int | None = None, skip_self: bool = False) -> DataFrame:
        """(query_id, item_id, cosine, rank): neighbours of queries (query_id, embedding); cosines are exact."""
        found = [self._ranked(rows, k, probes or self.probes, max(k, depth or self.depth), skip_self) for rows in self._blocks(queries)]
        if not found:
            return self.table.where("false").select(F.lit(0).cast("long").alias("query_id"), "item_id", F.lit(0.0).alias("cosine"), F.lit(0).cast("long").alias("rank"))
        return found[0] if len(found) == 1 else reduce(DataFrame.unionAll, [written(f, "neighbours") for f in found])

    def share_read(self, k: int) -> float:
        """The share of all vectors that a search for k neighbours reads of each query."""
        return min(1.0, max(k, self.depth) / max(1, self.rows))


def _unit_rows(rows: list) -> np.ndarray:
    q = np.array([r.v for r in rows], dtype=np.float64)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def _parts(dim: int) -> int:
    """As many codebooks as the dimension allows, up to 64, of two components each or more."""
    return next((dim // w for w in range(2, dim) if dim % w == 0 and dim // w <= 64), 1)


def build(vectors: DataFrame, lists: int | None = None, recall: float = RECALL, seed: int = 7) -> VectorIndex | None:
    """The index of vectors (item_id, embedding), or None where none is usable."""
    spark = vectors.sparkSession
    sizes = usable(vectors, "item_id").groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim, n = sizes[0].dim, sizes[0].n
    rows = usable(vectors, "item_id", dim)
    digest = F.xxhash64(F.lit(seed), "item_id")
    chosen = rows.where(F.pmod(digest, F.lit(-(-n // TRAIN_ROWS))) == 0) if n > TRAIN_ROWS else rows
    sample = Table(chosen.withColumn("h", digest).repartition(max(1, min(16, n // 4096))), "training")
    k = lists or int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(1.0, np.sqrt(n)) / 2)))))
    first = sample.df.orderBy("h", "item_id").limit(max(k, WORDS)).collect()
    start = _unit_rows(first)
    centres = _rounds(sample.df, start[None, :k], lambda x, c: [(x, _nearest(x, c[0]))], ROUNDS)[0]
    parts = _parts(dim)
    residual = (start - centres[_nearest(start, centres)]).reshape(len(start), parts, -1).transpose(1, 0, 2)[:, :WORDS]

    def by_part(x: np.ndarray, books: np.ndarray):
        left = (x - centres[_nearest(x, centres)]).reshape(len(x), parts, -1)
        return [(left[:, p], _nearest(left[:, p], books[p])) for p in range(parts)]

    books = _rounds(sample.df, residual, by_part, ROUNDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"), batch.num_rows)
                placed = np.stack([at for _, at in by_part(x, books)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centres).astype(np.int32)), batch.column("item_id"), pa.array([c.tobytes() for c in placed], pa.binary()), batch.column("v")], ["list", "item_id", "code", "v"])

    path = fresh_path(spark, "vector_index")
    coded = rows.mapInArrow(encode, "list int, item_id long, code binary, v array<double>").withColumn("v", F.col("v").cast("array<float>"))
    coded.repartition("list", F.pmod(F.xxhash64("item_id"), F.lit(8))).sortWithinPartitions("list", "item_id").write.partitionBy("list").parquet(path)
    index = VectorIndex(spark.read.schema(coded.schema).parquet(path), centres, books, n)
    _tune(index, sample.df, recall)
    sample.drop()
    return index


def _tune(index: VectorIndex, sample: DataFrame, recall: float) -> None:
    """Sets the least probes and depth that find ``recall`` of the exact neighbours of a sample's vectors."""
    from corvane.operators.retrieval import knn

    asked = sample.orderBy("h", "item_id").limit(TUNE_QUERIES).select(F.col("item_id").alias("query_id"), F.col("v").alias("embedding")).dropDuplicates(["query_id"])
    exact = {(r.query_id, r.item_id) for r in knn(index.table.select("item_id", F.col("v").alias("embedding")), asked, TUNE_NEIGHBOURS + 1, skip_self=True).where(F.col("rank") <= TUNE_NEIGHBOURS).collect()}
    if not exact:
        return
    rows = next(index._blocks(asked))
    lists, need = len(index.centres), int(np.ceil(recall * len(exact)))
    probes, deep = max(1, lists // 32), max(10 * TUNE_NEIGHBOURS, min(2000, index.rows // 20))
    while True:
        found = index.candidates(rows, probes, deep).where("query_id <> item_id").select("query_id", "item_id", "rank").collect()
        hit = np.sort([r["rank"] for r in found if (r.query_id, r.item_id) in exact])
        if len(hit) >= need or (probes >= lists and deep >= index.rows):
            index.probes = probes
            index.depth = int(hit[min(need, len(hit)) - 1]) + 1 if len(hit) else deep
            return
        if probes < lists:  # more lists first, then deeper
            probes = min(lists, probes * 2)
        else:
            deep *= 4
