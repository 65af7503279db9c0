"""Text sinks: research notes in Markdown, bibliographies in BibTeX and GB/T 7714, evidence tables in CSV lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


PAGE = 200


def markdown(notes: DataFrame, page: int = PAGE) -> DataFrame:
    """(topic, page, body) of notes (topic, pos, text, url): a heading and a list of quoted points with their source.

    A page holds the notes of ``page`` positions, so a topic of any size is never gathered whole.
    """
    line = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" ([source]("), "url", F.lit("))"))
    rows = notes.select("topic", F.floor(F.col("pos") / page).alias("page"), "pos", line.alias("line"))
    return rows.groupBy("topic", "page").agg(F.concat(F.lit("# "), F.first("topic"), F.lit("\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("body"))


def bibtex(records: DataFrame) -> DataFrame:
    """(record_id, entry): keys are author, year and first word; equal keys get a, b, c in the order of record_id."""
    word = F.regexp_extract(F.lower("title"), r"([\p{L}\p{N}]+)", 1)
    base = F.concat(F.regexp_replace(F.lower("author"), r"[^\p{L}]", ""), F.coalesce(F.col("year").cast("string"), F.lit("nd")), word)
    w = Window.partitionBy("base")
    nth, n = F.row_number().over(w.orderBy("record_id")), F.count(F.lit(1)).over(w)
    keyed = records.withColumn("base", base).withColumn("key", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.when(nth <= 26, F.char(96 + nth)).otherwise(nth.cast("string")))))
    body = F.concat(F.lit("@article{"), "key", F.lit(",\n  title = {"), F.regexp_replace("title", r"[{}]", ""), F.lit("},\n  author = {"), "author", F.lit("},\n  year = {"), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("}\n}"))
    return keyed.select("record_id", body.alias("entry"))


def numbered(df: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """Adds n, the place in the order of an integer key: counts of ranges of the key are summed up, and rows are numbered inside their range."""
    placed = df.withColumn("_range", F.floor(F.col(key) / width))
    before = F.coalesce(F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_count")).select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return placed.withColumn("_inside", inside).join(starts, "_range").withColumn("n", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def gbt7714(records: DataFrame) -> DataFrame:
    """(record_id, entry) numbered in the order of record_id."""
    return numbered(records, "record_id").select("record_id", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.upper("author"), F.lit(". "), "title", F.lit("[J]. "), F.coalesce(F.col("year").cast("string"), F.lit("[n.d.]")), F.lit(".")).alias("entry"))


def csv_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of the columns, quoted where a comma, quote or line feed asks for it."""
    def cell(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))
