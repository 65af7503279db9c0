"""The library's tables, derived from the given ones by deterministic adapters, and the same in SQL.

Chunks are the non-blank lines of documents; a benchmark item is a query made of its first tokens;
orders and parts of lineitem stand for items and the entities they mention.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import spelling, title_index
from corvane.operators.search_index import SearchIndex, built, kept
from corvane.operators.vector_index import VectorIndex
from corvane.operators.vector_index import build as build_vectors
from corvane.tables import Table

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"),
        F.substring(F.trim(F.substring_index("text", "\n", 1)), 1, 60).alias("title"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("locator"),
        F.col("lang").alias("modality"),
        "source",
        F.col("n_chars").alias("size_bytes"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=(F.col("doc_id") % 720).cast("int"))).alias("content_time"),
        F.substring(F.sha2("text", 256), 1, 32).alias("fingerprint"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.where(F.trim("text") != "").select((F.col("doc_id") * 1_000_000_000 + F.col("n")).alias("chunk_id"), F.col("doc_id").alias("item_id"), F.col("n").cast("long").alias("chunk_index"), "text")


def index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of all chunks, built at its first use."""
    return built(spark, f"{sf_dir}/documents.parquet", lambda: chunks(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, cnt): the corpus vocabulary of words of 2 to 12 characters."""
    return index(spark, sf_dir).terms.where(F.length("term").between(spelling.LEAST, spelling.MOST)).select("term", "cnt")


def spelling_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, f"{sf_dir}/documents.parquet", "spelling", lambda: Table(spelling.spelling_index(words(spark, sf_dir)), "spelling").df)


def titles(spark: SparkSession, sf_dir: str) -> title_index.TitleIndex:
    return kept(spark, f"{sf_dir}/documents.parquet", "titles", lambda: title_index.build(items(spark, sf_dir)))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    return kept(spark, f"{sf_dir}/embeddings.parquet", "vectors", lambda: build_vectors(vectors(spark, sf_dir)))


def queries(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    """(query_id, query, terms) from the benchmark's items: each item's first tokens."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, words).alias("terms"))
    return b.select("query_id", F.array_join("terms", " ").alias("query"), F.array_distinct("terms").alias("terms"))


def query_terms(spark: SparkSession, sf_dir: str, words: int = 2) -> DataFrame:
    return queries(spark, sf_dir, words).select("query_id", F.explode("terms").alias("term")).distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that has a benchmark item's id stands for the embedded query."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return b.join(vectors(spark, sf_dir), F.col("query_id") == F.col("item_id")).select("query_id", "embedding")


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").where("event_type = 'view'").crossJoin(F.broadcast(n))
    return e.groupBy((F.col("event_id") % F.col("n")).alias("item_id")).agg(F.count(F.lit(1)).alias("opens"), F.max("ts").alias("last_opened_at"))


#: Lineitem rows, about, of a task that works on mentions or on the pairs made of them.
MENTION_ROWS = 500_000


def mention_tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many parts mentions are dealt, so that a part doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // MENTION_ROWS))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, item, content_time), distinct, dealt by item in as many parts as the table is large."""
    n = mention_tasks(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey").repartition(n, "l_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey")
    return li.hint("merge").join(o.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("item"), F.col("o_orderdate").alias("content_time")).distinct()


ITEMS = """items AS (
  SELECT doc_id AS item_id, trim(split_part(text, chr(10), 1))[1:60] AS title,
    '/' || source || '/' || lang || '/' || doc_id || '.txt' AS locator, lang AS modality, source, n_chars AS size_bytes,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS content_time, sha256(text)[1:32] AS fingerprint
  FROM documents)"""
CHUNKS = """chunks AS (
  SELECT doc_id * 1000000000 + n AS chunk_id, doc_id AS item_id, n AS chunk_index, line AS text FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
  WHERE trim(line) <> '')"""
TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"
POSTINGS = f"""postings AS (
  SELECT term, chunk_id, item_id, count(*) AS tf FROM (SELECT chunk_id, item_id, unnest({TOKENS.format('text')}) AS term FROM chunks) GROUP BY ALL)"""
STATS = f"stats AS (SELECT chunk_id, len({TOKENS.format('text')}) AS dl FROM chunks)"


def queries_sql(words: int = 2) -> str:
    return f"""queries AS (
  SELECT item_id AS query_id, array_to_string({TOKENS.format('text')}[1:{words}], ' ') AS query, {TOKENS.format('text')}[1:{words}] AS terms FROM benchmark),
query_terms AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM queries)"""


BM25 = """used AS (SELECT p.* FROM postings p WHERE term IN (SELECT term FROM query_terms)),
df AS (SELECT term, count(*) AS df FROM used GROUP BY term),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM stats),
wanted AS (SELECT query_id, count(*) AS k FROM query_terms GROUP BY query_id),
bm25 AS (
  SELECT query_id, chunk_id, item_id, score FROM (
    SELECT q.query_id, u.chunk_id, u.item_id, w.k, count(*) AS hit,
      round(sum(greatest(1e-6::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM used u JOIN query_terms q USING (term) JOIN df USING (term) JOIN wanted w USING (query_id) JOIN stats USING (chunk_id) CROSS JOIN corpus
    GROUP BY ALL) WHERE hit = k)"""
OPENS = """opens AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS item_id, count(*) AS opens, max(ts) AS last_opened_at FROM events WHERE event_type = 'view' GROUP BY 1)"""
KNN = """unit AS (SELECT vec_id AS item_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (
  SELECT q.item_id AS query_id, x.item_id, round(list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(x.v, x.v)), 6) AS cosine
  FROM unit q JOIN benchmark b ON b.item_id = q.item_id CROSS JOIN unit x)"""
MENTIONS = """mentions AS (
  SELECT DISTINCT l_partkey AS entity, l_orderkey AS item, o_orderdate AS content_time FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TITLE_HITS = """titles AS (SELECT item_id, lower(title) AS t, lower(locator) AS l, greatest(length(title) - 2, 0) + greatest(length(locator) - 2, 0) AS size FROM items),
title_stats AS (SELECT count(*) AS n, avg(size) AS mean FROM titles),
title_tf AS (SELECT query_id, item_id, size, (SELECT count(*) FROM range(1, length(t) - length(query) + 2) r(i) WHERE t[i:i + length(query) - 1] = query) + (SELECT count(*) FROM range(1, length(l) - length(query) + 2) r(i) WHERE l[i:i + length(query) - 1] = query) AS tf
  FROM titles JOIN queries ON length(query) >= 3 AND (contains(t, query) OR contains(l, query))),
title_df AS (SELECT query_id, count(*) AS df FROM title_tf GROUP BY query_id),
title_scored AS (SELECT query_id, item_id, round(greatest(1e-6::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)), 6) AS score FROM title_tf JOIN title_df USING (query_id) CROSS JOIN title_stats)"""
