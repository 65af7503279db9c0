"""Registered queries op1 to op13, the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import chat_format, conversation_repair, decontamination, embedding_dedup, filter_audit, language_id, license_scan, line_dedup, mixing, simhash, substring_dedup, suffix_dedup, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_digests(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_predictions(_read(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chat(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    turns, loss = chat_format.read_chat(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_digests(_read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(_read(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_decontamination, op3_simhash_dedup, op4_substring_dedup, op5_toxicity, op6_language_id, op7_chat_format, op8_line_dedup, op9_suffix_dedup, op10_mixing, op11_filter_audit, op12_conversation_repair, op13_license_scan, pipeline)}

OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS merged,
    length(replace(replace(text, '\', '\b'), '<', '\l')) AS body,
    length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN merged THEN 6 ELSE role_chars + 16 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), holders AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.holder IS NOT NULL AND h.holder <> k.doc_id AS gone
  FROM keyed k LEFT JOIN holders h USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS digest
  FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS cap,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio LIMIT 1)) AS target FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(round(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM placed
"""

OP11_SQL = r"""
WITH RECURSIVE measured AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), firsts AS (
  SELECT body, min(doc_id) AS first FROM measured GROUP BY body
), judged AS (
  SELECT m.doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
      100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body), regexp_matches(body, '[#$%&*|]'), coalesce(m.doc_id > first, false)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND toxic = 1) AS toxic
  FROM measured m JOIN firsts USING (body)
), cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, CAST(i AS INTEGER) AS step, substr(o, i, 1) AS f, substr(o, 1, i - 1) AS earlier FROM orders, range(1, 6) r(i) WHERE length(o) = 5
), met AS (
  SELECT part, o, step, f, n, good, toxic, fails[ord(f) - 64] AS own,
    len(list_filter(fails, lambda x: x)) AS all_fails, coalesce(list_bool_or(list_transform(range(1, step), lambda i: fails[ord(substr(o, i, 1)) - 64])), false) AS gone
  FROM cells, steps
), counted AS (
  SELECT part, o, step, f, CAST(sum(n) FILTER (NOT gone AND NOT own) AS BIGINT) AS kept, CAST(sum(n) FILTER (NOT gone AND own) AS BIGINT) AS removed, CAST(sum(n) FILTER (gone AND own) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (own AND all_fails = 1) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (NOT gone AND own) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (NOT gone AND own) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counted
"""

OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 8 * length(k)), lambda i: CASE WHEN i % 8 = 0 THEN ord(substr(k, CAST(i / 8 + 1 AS BIGINT), 1)) ELSE 0 END)),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS fate FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(CASE WHEN fate = 3 THEN 2 ELSE 1 END) WHERE fate <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM hurt
), judged AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS earlier, CASE WHEN final = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), moves(p, role, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserts(p, k, q) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (3, 0, 3), (3, 1, 2)),
edits(p, needs, letter, cost, q) AS (
  SELECT p, role, 'K', 0, q FROM moves UNION ALL SELECT p, NULL, 'R', 3, q FROM moves WHERE role <> 's' UNION ALL SELECT p, NULL, 'D', 4, p FROM range(4) r(p)
), best(conv_id, i, q, way) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(q AS BIGINT), {'cost': CAST(3 * k AS BIGINT), 'audit': repeat('I', k)} FROM conversations, inserts WHERE p = 0
  UNION ALL
  SELECT b.conv_id, j.i, CAST(n.q AS BIGINT), min({'cost': CAST(b.way.cost + e.cost + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END + 3 * n.k AS BIGINT), 'audit': b.way.audit || letter || repeat('I', n.k)})
  FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i + 1
  JOIN edits e ON e.p = b.q AND (needs IS NULL OR needs = initial) AND (letter = 'D' OR fault IS NULL OR fault = 'truncated') JOIN inserts n ON n.p = e.q
  GROUP BY b.conv_id, j.i, n.q
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), chosen AS (
  SELECT b.conv_id, min(way) AS way FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n WHERE q IN (0, 3) GROUP BY b.conv_id
), letters AS (
  SELECT conv_id, way.audit AS audit, unnest(string_split(way.audit, '')) AS letter, generate_subscripts(string_split(way.audit, ''), 1) AS nth FROM chosen WHERE way.audit <> ''
), made AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS of_row, count(*) FILTER (letter <> 'D') OVER w - 1 AS made, length(replace(audit, 'D', '')) % 2 AS odd FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY nth)
), texts AS (
  SELECT m.conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS whole
  FROM made m LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM m.conv_id AND j.i = m.of_row WHERE letter <> 'D' GROUP BY m.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted d ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen x ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE_SQL = {"op11_filter_audit": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op7_chat_format": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_mixing": OP10_SQL}
