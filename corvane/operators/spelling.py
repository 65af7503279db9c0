"""Spelling help over a corpus vocabulary by symmetric deletes.

Two words are within k edits only if deleting at most k characters of each leaves a common string, so an
index of every known word under all its deletions, looked up with all deletions of a misspelt word,
lists every known word within k edits, wherever the edits are. What it lists is verified by the edit
distance. The index is a table, built once; a batch of misspelt words is one equi-join with it.

A word of up to ``SHORT`` characters may differ in one edit and a longer one in two; of the known
words within that the most frequent is suggested, then the nearest, then the first. Known words get none. Null and
empty words are left out. A suggestion counts only if the query it gives finds something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.search_index import SearchIndex

LEAST, MOST = 2, 12
SHORT = 3


def _shorter(word: Column) -> Column:
    """The word without one character, for each of its characters."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, most: Column) -> Column:
    """The word and what deleting up to ``most`` (1 or 2) of its characters leaves."""
    once = _shorter(word)
    twice = F.when(most > 1, F.flatten(F.transform(once, _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def allowed(word: Column) -> Column:
    return F.when(F.length(word) <= SHORT, 1).otherwise(2)


def spelling_index(vocabulary: DataFrame) -> DataFrame:
    """(key, suggestion, cnt) of known words (term, cnt): each under all its deletions.

    A known word may be one character longer than a misspelt word that allows one edit, and such words need one
    deletion only; two are indexed for all, as the longer misspelt words need them.
    """
    known = vocabulary.where(F.length("term").between(LEAST, MOST))
    return known.select(F.explode(deletions(F.col("term"), F.lit(2))).alias("key"), F.col("term").alias("suggestion"), "cnt")


def suggestions(words: DataFrame, index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, suggestion, distance, cnt): the best known word for each unknown one of words (term, ..)."""
    asked = words.where(F.length("term").between(LEAST, MOST)).select("term").distinct().join(vocabulary.select("term"), "term", "left_anti").withColumn("most", allowed(F.col("term")))
    keyed = asked.select("term", "most", F.explode(deletions(F.col("term"), F.col("most"))).alias("key"))
    listed = keyed.join(index, "key").where(F.abs(F.length("term") - F.length("suggestion")) <= F.col("most")).select("term", "most", "suggestion", "cnt").distinct()
    near = listed.withColumn("distance", F.levenshtein("term", "suggestion", 2).cast("long")).where(F.col("distance").between(0, F.col("most")))
    return near.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("cnt"), "distance", "suggestion"))).where("r = 1").select("term", "suggestion", "distance", "cnt")


def corrected(query_terms: DataFrame, found: DataFrame, postings: DataFrame | SearchIndex) -> DataFrame:
    """(query_id, term, suggestion, fixed, n): each suggested change of a query, run again; only those with results.

    ``query_terms`` has (query_id, nth, term) in order; one misspelt word is changed at a time, as the others may be right.
    ``postings`` is an index or has at least those (term, chunk_id) of all terms and suggestions. n is the number of chunks that hold every word of the changed query.
    """
    tries = query_terms.join(found, "term").select("query_id", "nth", "term", "suggestion").distinct()
    own = tries.withColumnRenamed("nth", "at").join(query_terms.select("query_id", "nth", F.col("term").alias("word")), "query_id")
    changed = own.withColumn("word", F.when(F.col("nth") == F.col("at"), F.col("suggestion")).otherwise(F.col("word")))
    whole = changed.groupBy("query_id", "at", "term", "suggestion").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]), " ").alias("fixed"), F.count_distinct("word").alias("k"))
    wanted = changed.select("query_id", "at", F.col("word").alias("term")).distinct()
    held = postings.matched(wanted, "chunk_id") if isinstance(postings, SearchIndex) else postings.select("term", "chunk_id").join(wanted, "term")
    hit = held.groupBy("query_id", "at", "chunk_id").agg(F.count(F.lit(1)).alias("hit"))
    counted = hit.join(whole, ["query_id", "at"]).where("hit = k").groupBy("query_id", "at").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(counted, ["query_id", "at"]).select("query_id", "term", "suggestion", "fixed", "n")
