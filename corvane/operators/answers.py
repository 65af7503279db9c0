"""Quoted answers, questions a document can answer, and help when nothing was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import folded, sentences

#: Signs of a question.
QUESTION_HINTS = ["怎么", "如何", "为什么", "为何", "什么", "哪个", "哪些", "是不是", "能不能", "要不要", "多少", "多久", "几个", "区别", "差别", "吗", "呢", "?", "？", "how", "why", "what", "which", "when"]


def is_question(query: Column) -> Column:
    low = F.lower(F.trim(query))
    return (F.length(low) >= 4) & F.exists(F.array(*[F.lit(h) for h in QUESTION_HINTS]), lambda h: F.contains(low, h))


def covered_sentences(hits: DataFrame, least: int = 8, most: int = 160) -> DataFrame:
    """Sentences of hits (query_id, chunk_id, text, terms) with the share of the query's terms that each holds."""
    cut = hits.select("query_id", "chunk_id", "terms", F.posexplode(sentences(F.col("text"), least, most)).alias("i", "sentence"))
    held = F.size(F.filter("terms", lambda t: F.contains(folded(F.col("sentence")), t)))
    return cut.withColumn("coverage", F.round(held / F.size("terms"), 3)).drop("terms")


def answer_cards(sents: DataFrame, least: float = 0.5, take: int = 2) -> DataFrame:
    """(query_id, chunk_id, answer, coverage): the best sentences of a query's first hit, in their order there."""
    ok = sents.where(F.col("coverage") >= least)
    best = ok.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("coverage"), "i"))).where(F.col("r") <= take)
    return best.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "sentence"))), lambda s: s["sentence"]), " ").alias("answer"), F.max("coverage").alias("coverage"))


def passages(sents: DataFrame, least: float = 0.3, per_source: int = 2) -> DataFrame:
    """Sentences that cover enough of a question, the best two of each source."""
    ok = sents.where(F.col("coverage") >= least)
    return ok.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy(F.desc("coverage"), "chunk_id", "i"))).where(F.col("r") <= per_source)


def drop_one(items: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(dropped, n): how many items are left without each filter, and with all, counted in one pass."""
    names = list(filters)
    all_but = {n: [filters[m] for m in names if m != n] for n in names} | {"none": list(filters.values())}

    def every(tests: list[Column]) -> Column:
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    counts = items.agg(*[F.count_if(every(tests)).alias(n) for n, tests in all_but.items()])
    return counts.unpivot([], list(all_but), "dropped", "n")


def split_terms(known: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, term, n): how many chunks each single word of a query would find, by the known terms (term, df)."""
    return query_terms.join(known.select("term", "df"), "term", "left").select("query_id", "term", F.coalesce("df", F.lit(0)).alias("n"))


def questions(chunks: DataFrame, per_item: int = 2) -> DataFrame:
    """(item_id, kind, chunk_id, rank): what a chunk could answer by its wording, at most two of a kind an item."""
    text = F.lower("text")
    kind = F.when(text.rlike(r"( is (a|an|the) | means | refers to |是指|定义为)"), "define").when(text.rlike(r"(found that|results show|shows that|发现|表明)"), "finding").when(text.rlike(r"(method|approach|using |方法|采用)"), "method").when(text.rlike(r"( than |compared|versus|相比|优于)"), "compare").when(text.rlike(r"[0-9]+(\.[0-9]+)?%?"), "number")
    w = Window.partitionBy("item_id", "kind").orderBy("chunk_id")
    return chunks.withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_item).select("item_id", "kind", "chunk_id", "rank")
