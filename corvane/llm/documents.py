"""The identity of a document row inside the operators on whole texts.

A row is known by its doc_id and a 64-bit hash of its text, so that a repeated or null doc_id
with another text is another document, and a row that is repeated as it is gets the same result
each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """(_d, _t, text): doc_id with a stand-in for null, a 64-bit hash of the text, the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_d"), text_key(text).alias("_t"), text.alias("text"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def doc_id() -> Column:
    return F.when(F.col("_d") != NO_ID, F.col("_d")).alias("doc_id")
