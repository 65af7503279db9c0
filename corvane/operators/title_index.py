"""Titles and locators by what they hold, ranked: a table of three-character grams and BM25 on the whole query.

Building cuts titles and locators into grams once. A search takes each query's ``PROBES`` rarest grams
and counts: only items in all of their postings can hold the query, and these few are compared with
it. A query is one phrase, as in a full-text index of grams: its frequency in an item is how often
it stands in title and locator, overlaps included, its document frequency is the number of items that hold it, and an
item's size is its number of grams. Letters are lower-cased. Queries of under three characters find nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.retrieval import top, trigrams
from corvane.tables import Table, fresh_path

BUCKETS = 64
PROBES = 3
LIMIT = 60


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def occurrences(text: Column, phrase: Column) -> Column:
    """How often a phrase stands in a text, overlaps included."""
    last = F.length(text) - F.length(phrase) + 1
    places = F.filter(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.length(phrase)) == phrase)
    return F.when(F.contains(text, phrase), F.size(places)).otherwise(0)


@dataclass
class TitleIndex:
    """grams (bucket, gram, item_id), their frequencies (gram, df), and rows (item_id, t, l, size); how many rows, and their mean size."""

    grams: DataFrame
    frequencies: DataFrame
    rows: DataFrame
    n: int
    mean: float

    def search(self, queries: DataFrame, limit: int = LIMIT, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, item_id, score, rank) of queries (query_id, query); of ``allowed`` items only, whose scores stay those of all."""
        asked = queries.where(F.length("query") >= 3).select("query_id", F.lower("query").alias("q"))
        cut = asked.select("query_id", F.explode(trigrams(F.col("q"))).alias("gram"))
        rarest = cut.join(self.frequencies, "gram", "left").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "gram"))).where(F.col("r") <= PROBES)
        k = rarest.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("k"))
        posted = self.grams.join(rarest.select("query_id", "gram", _bucket(F.col("gram")).alias("bucket")), ["bucket", "gram"])
        counted = posted.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("hit"))
        listed = counted.join(k, F.col("query_id") == F.col("_q")).where("hit >= k").select("query_id", "item_id")
        held = listed.join(asked, "query_id").join(self.rows, "item_id").withColumn("tf", occurrences(F.col("t"), F.col("q")) + occurrences(F.col("l"), F.col("q"))).where("tf > 0")
        df = held.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("df"))
        idf = F.greatest(F.lit(1e-6), F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        score = F.round(idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("size") / self.mean)), 6)
        scored = held.join(df, F.col("query_id") == F.col("_q")).select("query_id", "item_id", score.alias("score"))
        if allowed is not None:
            scored = scored.join(allowed.select("item_id"), "item_id", "left_semi")
        return top(scored.select("query_id", "item_id", "score"), limit, F.desc("score"), F.col("item_id"))


def build(items: DataFrame) -> TitleIndex:
    """Writes the index of items (item_id, title, locator); null titles and locators are empty."""
    spark = items.sparkSession
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    read = items.select("item_id", low("title").alias("t"), low("locator").alias("l"))
    size = F.greatest(F.length("t") - 2, F.lit(0)) + F.greatest(F.length("l") - 2, F.lit(0))
    rows = Table(read.withColumn("size", size.cast("long")), "title_rows").df
    grams = rows.select("item_id", F.explode(F.array_union(trigrams(F.col("t")), trigrams(F.col("l")))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    path = fresh_path(spark, "title_grams")
    grams.repartition("bucket", F.pmod(F.xxhash64("item_id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
    posted = spark.read.schema(grams.schema).parquet(path)
    frequencies = Table(posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "title_frequencies").df
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    return TitleIndex(posted, frequencies, rows, whole.n, whole.mean or 1.0)
