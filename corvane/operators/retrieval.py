"""Keyword, substring and vector recall, fusion and ranking, for many queries at once.

Queries are rows with a query_id; every step keeps it, so a batch of queries is one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.search_index import SearchIndex
from corvane.tables import written

RRF_K = 60
ROUTE_LIMIT = 200
#: Query vectors that go to the tasks at once; more queries are more passes over the vectors.
QUERY_BLOCK = 1024


def bm25(index: SearchIndex, query_terms: DataFrame, every_term: bool = True, once: bool = False) -> DataFrame:
    """(query_id, chunk_id, item_id, score): BM25 with k1 1.2, b 0.75 and the probabilistic idf, floored.

    ``query_terms`` has distinct (query_id, term). With ``every_term`` a chunk has to hold all terms of its query.
    Postings bring their chunk's size and the terms their frequency and come dealt by item, so sums need no shuffle of their own.
    A search that is done ``once`` writes no postings.
    """
    wanted = query_terms.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("k"))
    asked = query_terms.select("query_id", "term").join(wanted, F.col("query_id") == F.col("_q")).select("query_id", "term", "k")
    idf = F.greatest(F.lit(1e-6), F.log((index.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / index.avgdl))
    scored = index.matched(asked, once=once).withColumn("part", part)
    out = scored.groupBy("query_id", "chunk_id", "item_id", "k").agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("hit"))
    return (out.where("hit = k") if every_term else out).select("query_id", "chunk_id", "item_id", "score")


def top(df: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The first k rows of every query; Spark cuts each partition to k before it shuffles."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def best_chunks(hits: DataFrame, samples: int = 3) -> DataFrame:
    """(query_id, item_id, chunk_id, score, extra, more, rank): the best chunk of an item, others sampled and counted."""
    w = Window.partitionBy("query_id", "item_id").orderBy(F.desc("score"), "chunk_id")
    ranked = hits.withColumn("r", F.row_number().over(w))
    out = ranked.groupBy("query_id", "item_id").agg(
        F.min_by("chunk_id", "r").alias("chunk_id"),
        F.max("score").alias("score"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r").between(2, samples + 1), F.struct("r", "chunk_id")))), lambda x: x["chunk_id"]).alias("extra"),
        F.greatest(F.count(F.lit(1)) - 1 - samples, F.lit(0)).cast("long").alias("more"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")).cast("long"))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.array_distinct(F.when(F.length(text) >= 3, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, 3))).otherwise(F.array().cast("array<string>")))


def cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds cosine to pairs (query_id, item_id, ..); null where one of them has no vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    q = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_q"))
    v = vectors.select("item_id", F.col("embedding").cast("array<double>").alias("_v"))
    joined = pairs.join(q, "query_id", "left").join(v, "item_id", "left")
    size = F.sqrt(dot(F.col("_q"), F.col("_q"))) * F.sqrt(dot(F.col("_v"), F.col("_v")))
    return joined.withColumn("cosine", F.round(F.try_divide(dot(F.col("_q"), F.col("_v")), size), 6)).drop("_q", "_v")


def knn(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """(query_id, item_id, cosine, rank): exact nearest neighbours of queries (query_id, embedding) in (item_id, embedding).

    A block of about QUERY_BLOCK query vectors goes to the tasks at a time, and of several blocks each
    one's result is written before the next is read, so the driver holds one block. Each batch of
    vectors is one matrix product that keeps its own top k a query, so what is shuffled is k rows a
    query and batch. A vector without length has cosine 0 with all; rows without id or vector are left out.
    """
    asked = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null AND query_id is not null")
    have = vectors.select(F.col("item_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null AND item_id is not null")
    blocks = -(-asked.count() // QUERY_BLOCK)
    if blocks <= 1:
        return _knn_block(have, asked.orderBy("query_id").collect(), k, skip_self)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    tables = [written(_knn_block(have, asked.where(block == b).orderBy("query_id").collect(), k, skip_self), "neighbours") for b in range(blocks)]
    return reduce(DataFrame.unionAll, tables)


def _knn_block(have: DataFrame, rows: list, k: int, skip_self: bool) -> DataFrame:
    """Neighbours of one block of queries, which goes to the tasks."""
    if not rows:
        return have.where("false").select(F.lit(0).cast("long").alias("query_id"), "item_id", F.lit(0.0).alias("cosine"), F.lit(0).cast("long").alias("rank"))
    ids, q = np.array([r.query_id for r in rows], dtype=np.int64), _unit(np.array([r.v for r in rows], dtype=np.float64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            item = np.asarray(batch.column("item_id"))
            x = _unit(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(item), -1))
            cos = np.round(q @ x.T, 6)
            if skip_self:
                cos[ids[:, None] == item[None, :]] = -2
            take = min(k, len(item))
            best = _first(cos, item, take)
            keep = np.take_along_axis(cos, best, axis=1).ravel() >= -1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, take)[keep]), pa.array(item[best].ravel()[keep]), pa.array(np.take_along_axis(cos, best, axis=1).ravel()[keep])], ["query_id", "item_id", "cosine"])

    return top(have.mapInArrow(search, "query_id long, item_id long, cosine double"), k, F.desc("cosine"), F.col("item_id"))


def _first(cos: np.ndarray, item: np.ndarray, take: int) -> np.ndarray:
    """The columns of the ``take`` highest values of each row, by item where values are equal; only what reaches the row's bound is sorted."""
    if take == cos.shape[1]:
        return np.lexsort((np.broadcast_to(item, cos.shape), -cos), axis=1)
    out = np.empty((len(cos), take), dtype=np.int64)
    bounds = np.partition(cos, cos.shape[1] - take, axis=1)[:, cos.shape[1] - take]
    for row, bound, to in zip(cos, bounds, out, strict=True):
        at = np.flatnonzero(row >= bound)
        to[:] = at[np.lexsort((item[at], -row[at]))[:take]]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def fuse(routes: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Reciprocal-rank fusion of routes (query_id, item_id, rank): rrf, the rank in each route and the routes."""
    used = {n: r for n, r in routes.items() if weights.get(n, 1.0) > 0}
    every = None
    for name, route in used.items():
        own = route.select("query_id", "item_id", F.lit(name).alias("route"), "rank", (F.lit(float(weights.get(name, 1.0))) / (RRF_K + F.col("rank"))).alias("part"))
        every = own if every is None else every.unionByName(own)
    ranks = [F.min(F.when(F.col("route") == n, F.col("rank"))).alias(f"{n}_rank") for n in used]
    return every.groupBy("query_id", "item_id").agg(F.round(F.sum("part"), 8).alias("rrf"), *ranks)


#: Ranking weights by preset; a preset names what differs from balanced.
BALANCED = {"semantic": 1.0, "keyword": 1.0, "recency": 0.3, "source_trust": 0.2, "popularity": 0.2, "title_boost": 0.5, "personal": 0.25, "diversity": 0.5, "length_penalty": 0.3}
PRESETS = {
    "balanced": {},
    "precise": {"semantic": 0.4, "keyword": 1.5, "recency": 0.1, "title_boost": 0.8, "length_penalty": 0.6},
    "semantic": {"semantic": 1.5, "keyword": 0.5, "recency": 0.1, "diversity": 0.8},
    "recent": {"semantic": 0.8, "keyword": 0.8, "recency": 1.5, "diversity": 0.3},
    "deep": {"semantic": 1.2, "keyword": 1.0, "diversity": 0.0, "length_penalty": 0.2},
    "factcheck": {"semantic": 1.0, "keyword": 1.1, "source_trust": 1.2, "diversity": 0.7},
    "compare": {"semantic": 1.2, "keyword": 0.9, "diversity": 1.0, "length_penalty": 0.2},
}


def weights_of(preset: str) -> dict[str, float]:
    return BALANCED | PRESETS["semantic" if preset == "explore" else preset]


def intent(query: Column) -> Column:
    """compare, factcheck, precise, explore or balanced, by the first rule that holds."""
    q = F.trim(query)
    return (
        F.when(q == "", "balanced")
        .when(q.rlike(r"(?i)(哪个更|哪个好|对比|比较|区别|优劣|\bvs\.?\b)"), "compare")
        .when(q.rlike(r"(是不是真的|真的假的|求证|核实|是否属实|真伪|有没有证据)"), "factcheck")
        .when(q.rlike(r'["“”]|[/\\]|\.[A-Za-z0-9]{1,5}\b|[a-z]+_[a-z]|[a-z][A-Z]'), "precise")
        .when(q.rlike(r"^(关于|有什么|有没有|推荐|了解一下)") | (F.length(q) <= 6), "explore")
        .otherwise("balanced")
    )


def rank_signals(cands: DataFrame, weights: dict[str, float], as_of: str) -> DataFrame:
    """Adds fresh, popularity, personal, title_hit, trust, short and score.

    Candidates are (query_id, item_id, rrf, content_time, opens, clicks, title_hits, n_terms, origin, n_chars).
    Popularity and clicks are relative to the most among the query's candidates.
    """
    w = Window.partitionBy("query_id")
    days = F.greatest(F.lit(0.0), (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("content_time").cast("timestamp"))) / 86400.0)
    relative = lambda c: F.when(F.max(c).over(w) > 0, F.log1p(F.col(c)) / F.log1p(F.greatest(F.max(c).over(w), F.lit(1)))).otherwise(0.0)
    signals = cands.withColumns({
        "fresh": F.coalesce(F.exp(-days / 180.0), F.lit(0.0)),
        "popularity": F.when(F.max("opens").over(w) > 1, F.log1p("opens") / F.log1p(F.max("opens").over(w))).otherwise(0.0),
        "personal": relative("clicks"),
        "title_hit": F.when(F.col("n_terms") > 0, F.least(F.lit(1.0), F.col("title_hits") / F.col("n_terms"))).otherwise(0.0),
        "trust": F.when(F.col("origin") == "file", 1.0).when(F.col("origin") == "chat-export", 0.9).when(F.col("origin") == "mail", 0.8).when(F.col("origin") == "clipboard", 0.7).otherwise(0.6),
        "short": F.greatest(F.lit(0.0), 1.0 - F.col("n_chars") / 240.0),
    })
    bonus = sum((F.lit(weights[k]) * F.col(c) for k, c in (("recency", "fresh"), ("popularity", "popularity"), ("title_boost", "title_hit"), ("source_trust", "trust"), ("personal", "personal"))), F.lit(0.0))
    return signals.withColumn("score", F.round(F.greatest(F.lit(1e-9), F.col("rrf") + 0.01 * (bonus - weights["length_penalty"] * F.col("short"))), 8))


def diversify(ranked: DataFrame, decay: float, bucket: str = "bucket") -> DataFrame:
    """The nth row of a bucket counts 1 / (1 + decay * n); adds factor, final and the new rank."""
    nth = F.row_number().over(Window.partitionBy("query_id", bucket).orderBy(F.desc("score"), "item_id")) - 1
    out = ranked.withColumn("factor", F.round(1.0 / (1.0 + decay * nth), 4)).withColumn("final", F.round(F.col("score") / (1.0 + decay * nth), 8))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "item_id")).cast("long"))


def expand_synonyms(query_terms: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, term, alternative): each term with itself and up to ``most`` synonyms, one hop, both ways."""
    both = pairs.select("a", "b").unionAll(pairs.select("b", "a")).where("a <> b").distinct()
    few = both.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where(F.col("r") <= most)
    return query_terms.select("query_id", "term", F.col("term").alias("alternative")).unionAll(query_terms.join(few, F.col("term") == F.col("a")).select("query_id", "term", F.col("b"))).distinct()


def match_alternatives(index: SearchIndex, expanded: DataFrame) -> DataFrame:
    """(query_id, chunk_id, item_id): chunks that hold, for every term of the query (query_id, term, alternative), one of its alternatives."""
    wanted = expanded.groupBy(F.col("query_id").alias("_q")).agg(F.count_distinct("term").alias("k"))
    asked = expanded.join(wanted, F.col("query_id") == F.col("_q")).select("query_id", F.col("term").alias("meant"), F.col("alternative").alias("term"), "k")
    hit = index.matched(asked).groupBy("query_id", "chunk_id", "item_id", "k").agg(F.count_distinct("meant").alias("hit"))
    return hit.where("hit = k").select("query_id", "chunk_id", "item_id")


def excluded_items(index: SearchIndex, exclusions: DataFrame) -> DataFrame:
    """(query_id, item_id) of items with a chunk that holds all excluded terms (query_id, term) of the query."""
    own = exclusions.select("query_id", "term").distinct()
    return match_alternatives(index, own.withColumn("alternative", F.col("term"))).select("query_id", "item_id").distinct()
