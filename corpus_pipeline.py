"""A corpus pipeline: documents in, a mix of clean and deduplicated documents out.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and calls one
operator of ``corvane.llm``. Columns of the documents that have names used inside, such as a score, are
left as they are: all but id and text go through in one struct. ``run`` writes every stage to a table in the shared folder and reads
it back, so a lost executor costs a re-read of the last table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, line_dedup, mixing, simhash, toxicity
from corvane.llm.documents import NO_ID
from corvane.tables import written

#: documents that score this much or more are rejected, as the operator's own prediction has it
MAX_TOXICITY = toxicity.THRESHOLD


def _others(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c != "text"]


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents' columns of rows (text, row): the text and the struct of all others."""
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below MAX_TOXICITY; the model learns from ``labels``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("text", F.struct(*_others(docs)).alias("row")), model)
    return _unpacked(scored.where(F.col("toxicity") < MAX_TOXICITY), docs)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share; n_chars follows the text."""
    out = _unpacked(line_dedup.drop_lines(docs.select("doc_id", "text", F.struct(*_others(docs)).alias("row"))), docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id and then text hash, of each group of near duplicates.

    Five-word shingles and a similarity of 0.8 or more, see ``simhash.similar_rows``. A row is known by
    its id and text: a null id, which comes last, is no group of its own, one id with two texts is two
    documents, and of rows repeated with the same id and text one is kept, whatever their other columns.
    Documents without words are a group of their own kind and keep one as well.
    """
    rows = simhash.similar_rows(docs)
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(NO_ID)).alias("_d"), F.col("text_key").alias("_t"))).alias("best"))
    keyed = docs.select("text", F.struct(*_others(docs)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), simhash.text_hash(F.col("text")).alias("_t"))
    return _unpacked(keyed.join(best.select("best._d", "best._t"), ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item; a matter of the text alone, so rows are known by its hash."""
    keyed = docs.select("text", F.struct(*_others(docs)).alias("row"), simhash.text_hash(F.col("text")).alias("_t"))
    found = decontamination.contaminated_pairs(keyed.select(F.col("_t").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(keyed.join(found.select(F.col("doc_id").alias("_t")).distinct(), "_t", "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for each repetition of a document, with the text taken in it; n_chars follows the text.

    Documents of which the mix takes nothing are left out, so sources have their target shares of words.
    """
    out = mixing.mixed(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The first stage is a trained model, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
