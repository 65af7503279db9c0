"""Queries on sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.sources import exports as X

QUERIES, ORACLE_SQL, query = registry()
_RECORDS = "records AS (SELECT p_partkey AS record_id, p_name || ' ' || p_type AS title, p_brand AS author, CASE WHEN p_partkey % 4 <> 0 THEN 1990 + p_size END AS year FROM part)"


def _records(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.concat("p_name", F.lit(" "), "p_type").alias("title"), F.col("p_brand").alias("author"), F.when(F.col("p_partkey") % 4 != 0, 1990 + F.col("p_size")).alias("year"))


@query(rf"""WITH {_RECORDS}, b AS (SELECT *, regexp_replace(lower(author), '[^\p{{L}}]', '', 'g') || coalesce(CAST(year AS VARCHAR), 'nd') || regexp_extract(lower(title), '([\p{{L}}\p{{N}}]+)', 1) AS base FROM records),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY record_id) AS nth, count(*) OVER (PARTITION BY base) AS n FROM b)
SELECT record_id, '@article{{' || base || (CASE WHEN n = 1 THEN '' WHEN nth <= 26 THEN chr(CAST(96 + nth AS INTEGER)) ELSE CAST(nth AS VARCHAR) END) || ',' || chr(10) || '  title = {{' || regexp_replace(title, '[{{}}]', '', 'g') || '}},' || chr(10) || '  author = {{' || author || '}},' || chr(10) || '  year = {{' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '}}' || chr(10) || '}}' AS entry FROM k""")
def export_bibtex(spark, sf_dir):
    return X.bibtex(_records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT record_id, '[' || row_number() OVER (ORDER BY record_id) || '] ' || upper(author) || '. ' || title || '[J]. ' || coalesce(CAST(year AS VARCHAR), '[n.d.]') || '.' AS entry FROM records")
def export_gbt7714(spark, sf_dir):
    return X.gbt7714(_records(spark, sf_dir))


@query("""SELECT source AS topic, doc_id // 200 AS page, '# ' || source || chr(10) || chr(10) || string_agg('- ' || replace(text, chr(10), ' ') || ' ([source](/' || doc_id || '))', chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1, 2, source""")
def export_markdown(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return X.markdown(d.select(F.col("source").alias("topic"), F.col("doc_id").alias("pos"), "text", F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("url")))


@query("""SELECT CAST(doc_id AS VARCHAR) || ',' || lang || ',' || (CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END) AS line FROM documents""")
def export_csv(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return X.csv_lines(d, ["doc_id", "lang", "text"])
