"""Queries on recall, fusion and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import folded, snippet, tokens
from corvane.functions.text import highlight_terms as marked_terms
from corvane.operators import retrieval as R
from corvane.operators.query_language import parse
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.views import BM25, CHUNKS, ITEMS, KNN, OPENS, POSTINGS, STATS, queries_sql

QUERIES, ORACLE_SQL, query = registry()

_BASE = f"WITH {CHUNKS}, {POSTINGS}, {STATS}, {queries_sql()}, {BM25}"


def _bm25(spark, sf_dir, once: bool = False) -> DataFrame:
    return R.bm25(V.index(spark, sf_dir), V.query_terms(spark, sf_dir), once=once)


@query(_BASE + " SELECT query_id, chunk_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm25) WHERE rank <= 200")
def bm25_topk(spark, sf_dir):
    return R.top(_bm25(spark, sf_dir), R.ROUTE_LIMIT, F.desc("score"), F.col("chunk_id"))


_BEST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY score DESC, chunk_id) AS r FROM bm25),
best AS (
  SELECT query_id, item_id, min(chunk_id) FILTER (r = 1) AS chunk_id, max(score) AS score,
    coalesce(list(chunk_id ORDER BY r) FILTER (r BETWEEN 2 AND 4), []) AS extra, greatest(count(*) - 4, 0) AS more
  FROM ranked GROUP BY query_id, item_id),
keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best)"""


@query(f"{_BASE}, {_BEST} SELECT query_id, item_id, chunk_id, score, array_to_string(extra, ',') AS extra, more, rank FROM keyword")
def bm25_best_chunk_extra_hits(spark, sf_dir):
    return R.best_chunks(_bm25(spark, sf_dir)).withColumn("extra", F.concat_ws(",", F.transform("extra", lambda x: x.cast("string"))))


@query(f"""WITH {ITEMS}, {queries_sql(1)}, {V.TITLE_HITS}
SELECT query_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM title_scored) WHERE rank <= 60""")
def title_substring(spark, sf_dir):
    return V.titles(spark, sf_dir).search(V.queries(spark, sf_dir, 1))


@query(f"WITH {ITEMS} SELECT item_id, locator, content_time FROM items WHERE starts_with(lower(locator), '/src1/') AND NOT starts_with(lower(locator), '/src1/fr') ORDER BY content_time DESC, item_id")
def prefix_scope_filter(spark, sf_dir):
    return parse("in:/SRC1/ -in:/src1/fr").filter(V.items(spark, sf_dir)).select("item_id", "locator", "content_time")


@query(f"""WITH {ITEMS} SELECT i.item_id, title, size_bytes FROM items i
WHERE modality IN ('en', 'de') AND content_time >= TIMESTAMP '2024-01-05' AND content_time < TIMESTAMP '2024-01-21' AND size_bytes > 2048
  AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = i.item_id AND l.quality = 1)""")
def mini_language_filter(spark, sf_dir):
    q = parse("type:en,de date:2024-01-05..2024-01-20 size:>2kb tag:quality:1")
    tags = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("tag"))
    return q.filter(V.items(spark, sf_dir), tags=tags).select("item_id", "title", "size_bytes")


@query(f"WITH {ITEMS} SELECT item_id, locator FROM items WHERE ends_with(lower(locator), '.txt') AND EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = items.item_id AND contains(lower(d.text), 'tion of the'))")
def extension_section_filter(spark, sf_dir):
    sections = V.chunks(spark, sf_dir).select("item_id", F.col("text").alias("section"))
    return parse('type:.txt section:"tion of the"').filter(V.items(spark, sf_dir), sections=sections).select("item_id", "locator")


@query("SELECT doc_id AS item_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 OR quality = 0)")
def tag_semi_join(spark, sf_dir):
    tags = V.table(spark, sf_dir, "labels").where("toxic = 1 OR quality = 0").select("doc_id")
    return V.table(spark, sf_dir, "documents").join(tags, "doc_id", "left_semi").select(F.col("doc_id").alias("item_id"), "lang")


@query(f"""{_BASE}, {_BEST}, gone AS (
  SELECT DISTINCT item_id FROM postings WHERE term IN ('was', 'from') GROUP BY chunk_id, item_id HAVING count(*) = 2)
SELECT query_id, item_id, rank FROM keyword WHERE item_id NOT IN (SELECT item_id FROM gone)""")
def exclude_anti_join(spark, sf_dir):
    words = V.queries(spark, sf_dir).select("query_id", F.explode(F.array(F.lit("was"), F.lit("from"))).alias("term"))
    gone = R.excluded_items(V.index(spark, sf_dir), words)
    return R.best_chunks(_bm25(spark, sf_dir)).join(gone, ["query_id", "item_id"], "left_anti").select("query_id", "item_id", "rank")


@query(f"""WITH {CHUNKS}, {POSTINGS}, {queries_sql()}, syn AS (
  SELECT lower(event_type) AS a, 'the' AS b FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT 'the', 'of' UNION ALL SELECT 'de', 'la' UNION ALL SELECT 'und', 'die'),
both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM syn UNION ALL SELECT b, a FROM syn) WHERE a <> b),
few AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM both_ways) WHERE r <= 6),
expanded AS (SELECT query_id, term, term AS alternative FROM query_terms UNION SELECT query_id, term, b FROM query_terms JOIN few ON term = a)
SELECT query_id, chunk_id, item_id FROM postings p JOIN expanded e ON p.term = e.alternative GROUP BY query_id, chunk_id, item_id
HAVING count(DISTINCT e.term) = (SELECT count(DISTINCT x.term) FROM expanded x WHERE x.query_id = e.query_id)""")
def synonym_or_expand(spark, sf_dir):
    types = V.table(spark, sf_dir, "events").select(F.lower("event_type").alias("a"), F.lit("the").alias("b")).distinct()
    syn = types.unionAll(spark.createDataFrame([("the", "of"), ("de", "la"), ("und", "die")], "a string, b string"))
    expanded = R.expand_synonyms(V.query_terms(spark, sf_dir), syn)
    return R.match_alternatives(V.index(spark, sf_dir), expanded)


@query(f"WITH {CHUNKS}, {queries_sql(3)} SELECT query_id, chunk_id FROM chunks JOIN queries ON len(terms) = 3 AND contains(' ' || array_to_string({V.TOKENS.format('text')}, ' ') || ' ', ' ' || query || ' ')")
def phrase_match(spark, sf_dir):
    """Chunks with the query's words side by side: candidates by all words, then the phrase."""
    c = V.chunks(spark, sf_dir)
    q = V.queries(spark, sf_dir, 3).where(F.size("terms") > 0)
    asked_terms = q.select("query_id", F.explode("terms").alias("term"))
    cand = R.match_alternatives(V.index(spark, sf_dir), asked_terms.withColumn("alternative", F.col("term")))
    flat = F.concat(F.lit(" "), F.array_join(tokens(F.col("text")), " "), F.lit(" "))
    asked = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, 3).alias("w")).where(F.size("w") == 3)
    return cand.join(c.select("chunk_id", "text"), "chunk_id").join(asked, "query_id").where(F.contains(flat, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))).select("query_id", "chunk_id")


@query(f"WITH {KNN} SELECT query_id, item_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM pairs) WHERE rank <= 20")
def vec_knn_exact(spark, sf_dir):
    return R.knn(V.vectors(spark, sf_dir), V.query_vectors(spark, sf_dir), 20)


@query(f"WITH {KNN} SELECT query_id, item_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM pairs WHERE query_id <> item_id) WHERE rank <= 5")
def similar_items(spark, sf_dir):
    return R.knn(V.vectors(spark, sf_dir), V.query_vectors(spark, sf_dir), 5, skip_self=True)


@query(f"WITH {KNN} SELECT query_id, item_id, cosine, rank FROM (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, p.item_id) AS rank FROM pairs p JOIN unit u USING (item_id) WHERE u.label IN (1, 3)) WHERE rank <= 10")
def vec_knn_filtered(spark, sf_dir):
    """The filter comes before the search, so that k neighbours are found if there are as many."""
    return R.knn(V.vectors(spark, sf_dir).where("label IN (1, 3)"), V.query_vectors(spark, sf_dir), 10)


_RRF = f"""{_BASE}, {_BEST}, {KNN},
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS rank FROM pairs) WHERE rank <= 200),
routes AS (
  SELECT query_id, item_id, 'keyword' AS route, rank FROM keyword WHERE rank <= 200
  UNION ALL SELECT query_id, item_id, 'semantic', rank FROM vec),
fused AS (
  SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf, min(rank) FILTER (route = 'keyword') AS keyword_rank, min(rank) FILTER (route = 'semantic') AS semantic_rank
  FROM routes GROUP BY query_id, item_id)"""


def _fused(spark, sf_dir) -> DataFrame:
    keyword = R.best_chunks(_bm25(spark, sf_dir)).where(F.col("rank") <= R.ROUTE_LIMIT)
    vec = R.knn(V.vectors(spark, sf_dir), V.query_vectors(spark, sf_dir), R.ROUTE_LIMIT)
    return R.fuse({"keyword": keyword, "semantic": vec}, {"keyword": 1.0, "semantic": 1.0})


@query(_RRF + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_id) AS rank FROM fused) WHERE rank <= 30")
def hybrid_rrf(spark, sf_dir):
    return R.top(_fused(spark, sf_dir), 30, F.desc("rrf"), F.col("item_id"))


@query(f"""{_RRF} SELECT f.query_id, f.item_id, keyword_rank IS NOT NULL OR coalesce(round(list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(x.v, x.v)), 6) >= 0.5, false) AS strong
FROM fused f LEFT JOIN unit q ON q.item_id = f.query_id LEFT JOIN unit x ON x.item_id = f.item_id""")
def weak_match_flag(spark, sf_dir):
    """Any channel but the vector makes a match strong, else a cosine of 0.5; weak ones are kept."""
    scored = R.cosines(_fused(spark, sf_dir), V.query_vectors(spark, sf_dir), V.vectors(spark, sf_dir))
    return scored.select("query_id", "item_id", (F.col("keyword_rank").isNotNull() | F.coalesce(F.col("cosine") >= 0.5, F.lit(False))).alias("strong"))


@query(_RRF + """ SELECT query_id, item_id, array_to_string(list_filter([CASE WHEN keyword_rank IS NOT NULL THEN 'keyword#' || keyword_rank END, CASE WHEN semantic_rank IS NOT NULL THEN 'semantic#' || semantic_rank END], lambda x: x IS NOT NULL), ' + ') AS reason, rrf FROM fused""")
def explain_routes(spark, sf_dir):
    part = lambda n: F.when(F.col(f"{n}_rank").isNotNull(), F.concat(F.lit(f"{n}#"), F.col(f"{n}_rank").cast("string")))
    return _fused(spark, sf_dir).select("query_id", "item_id", F.concat_ws(" + ", part("keyword"), part("semantic")).alias("reason"), "rrf")


_CANDS = f"""{_RRF}, {ITEMS}, {OPENS},
clicks AS (SELECT event_id % (SELECT count(*) FROM documents) AS item_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1),
cands AS (
  SELECT f.query_id, f.item_id, rrf, content_time, coalesce(opens, 0) AS opens, coalesce(clicks, 0) AS clicks, size_bytes AS n_chars,
    len(list_filter(q.terms, lambda t: length(t) >= 2 AND contains(strip_accents(lower(title)), t))) AS title_hits, len(list_filter(q.terms, lambda t: length(t) >= 2)) AS n_terms,
    '/' || source || '/' || modality AS bucket, CASE WHEN source IN ('src1', 'src2') THEN 'file' WHEN source = 'src3' THEN 'mail' ELSE source END AS origin
  FROM fused f JOIN items USING (item_id) JOIN (SELECT query_id, list_distinct(terms) AS terms FROM queries) q USING (query_id) LEFT JOIN opens USING (item_id) LEFT JOIN clicks USING (item_id)),
signals AS (
  SELECT *, exp(-greatest(0, (epoch(TIMESTAMP '{V.AS_OF}') - epoch(content_time)) / 86400.0::DOUBLE) / 180) AS fresh,
    CASE WHEN max(opens) OVER w > 1 THEN ln(1 + opens) / ln(1 + max(opens) OVER w) ELSE 0 END AS popularity,
    CASE WHEN max(clicks) OVER w > 0 THEN ln(1 + clicks) / ln(1 + max(clicks) OVER w) ELSE 0 END AS personal,
    CASE WHEN n_terms > 0 THEN least(1.0::DOUBLE, title_hits / n_terms::DOUBLE) ELSE 0 END AS title_hit,
    CASE origin WHEN 'file' THEN 1.0::DOUBLE WHEN 'chat-export' THEN 0.9::DOUBLE WHEN 'mail' THEN 0.8::DOUBLE WHEN 'clipboard' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS trust,
    greatest(0.0::DOUBLE, 1 - n_chars / 240.0::DOUBLE) AS short
  FROM cands WINDOW w AS (PARTITION BY query_id)),
scored AS (SELECT *, round(greatest(1e-9::DOUBLE, rrf + 0.01::DOUBLE * (0.3::DOUBLE * fresh + 0.2::DOUBLE * popularity + 0.5::DOUBLE * title_hit + 0.2::DOUBLE * trust + 0.25::DOUBLE * personal - 0.3::DOUBLE * short)), 8) AS score FROM signals)"""


def _signals(spark, sf_dir) -> DataFrame:
    n = V.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    clicks = V.table(spark, sf_dir, "events").where("event_type = 'click'").crossJoin(F.broadcast(n)).groupBy((F.col("event_id") % F.col("n")).alias("item_id")).agg(F.count(F.lit(1)).alias("clicks"))
    terms = F.filter("terms", lambda t: F.length(t) >= 2)
    cands = (
        _fused(spark, sf_dir).join(V.items(spark, sf_dir), "item_id").join(V.queries(spark, sf_dir).select("query_id", terms.alias("terms")), "query_id")
        .join(V.opens(spark, sf_dir).select("item_id", "opens"), "item_id", "left").join(clicks, "item_id", "left")
        .select(
            "query_id", "item_id", "rrf", "content_time", F.coalesce("opens", F.lit(0)).alias("opens"), F.coalesce("clicks", F.lit(0)).alias("clicks"), F.col("size_bytes").alias("n_chars"),
            F.size(F.filter("terms", lambda t: F.contains(folded(F.col("title")), t))).alias("title_hits"), F.size("terms").alias("n_terms"),
            F.concat(F.lit("/"), "source", F.lit("/"), "modality").alias("bucket"),
            F.when(F.col("source").isin("src1", "src2"), "file").when(F.col("source") == "src3", "mail").otherwise(F.col("source")).alias("origin"),
        )
    )
    return R.rank_signals(cands, R.weights_of("balanced"), V.AS_OF)


@query(_CANDS + " SELECT query_id, item_id, round(fresh, 6) AS fresh, round(popularity, 6) AS popularity, round(personal, 6) AS personal, round(title_hit, 6) AS title_hit, trust, round(short, 6) AS short, score FROM scored")
def rank_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("query_id", "item_id", *[F.round(c, 6).alias(c) for c in ("fresh", "popularity", "personal", "title_hit")], "trust", F.round("short", 6).alias("short"), "score")


@query(_CANDS + """, nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, item_id) - 1 AS d FROM scored),
final AS (SELECT query_id, item_id, bucket, score, round(1.0::DOUBLE / (1 + 0.5::DOUBLE * d), 4) AS factor, round(score / (1 + 0.5::DOUBLE * d), 8) AS final FROM nth)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, item_id) AS rank FROM final) WHERE rank <= 20""")
def diversity_rerank(spark, sf_dir):
    return R.diversify(_signals(spark, sf_dir), 0.5).where("rank <= 20").select("query_id", "item_id", "bucket", "score", "factor", "final", "rank")


@query(r"""SELECT doc_id, CASE WHEN q = '' THEN 'balanced' WHEN regexp_matches(q, '(哪个更|哪个好|对比|比较|区别|优劣)') OR regexp_matches(q, '(?i)\bvs\.?\b') THEN 'compare'
  WHEN regexp_matches(q, '(是不是真的|真的假的|求证|核实|是否属实|真伪|有没有证据)') THEN 'factcheck'
  WHEN regexp_matches(q, '["“”]|[/\\]|\.[A-Za-z0-9]{1,5}\b|[a-z]+_[a-z]|[a-z][A-Z]') THEN 'precise'
  WHEN regexp_matches(q, '^(关于|有什么|有没有|推荐|了解一下)') OR length(q) <= 6 THEN 'explore' ELSE 'balanced' END AS intent
FROM (SELECT doc_id, trim(split_part(text, chr(10), 1)[1:40]) AS q FROM documents)""")
def intent_weights(spark, sf_dir):
    q = F.trim(F.substring(F.substring_index("text", "\n", 1), 1, 40))
    return V.table(spark, sf_dir, "documents").select("doc_id", R.intent(q).alias("intent"))


@query(f"""WITH {CHUNKS}, hit AS (SELECT chunk_id, text, 'tion' AS term, strpos(text, 'tion') AS p FROM chunks WHERE contains(text, 'tion')),
cut AS (SELECT chunk_id, text, greatest(p - 1 - 53, 0) AS pos FROM hit)
SELECT chunk_id, (CASE WHEN pos > 0 THEN '…' ELSE '' END) || replace(replace(replace(replace(replace(text[pos + 1:pos + 160], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'tion', '<em>tion</em>') || (CASE WHEN pos + 160 < length(text) THEN '…' ELSE '' END) AS snippet FROM cut""")
def highlight_snippet(spark, sf_dir):
    c = V.chunks(spark, sf_dir).where(F.contains("text", F.lit("tion")))
    return c.select("chunk_id", snippet(F.col("text"), F.lit("tion")).alias("snippet"))


@query(f"""WITH cut AS (SELECT item_id AS query_id, {V.TOKENS.format('text')} AS t FROM benchmark)
SELECT query_id, array_to_string(CASE WHEN t[1] = t[3] THEN [t[1]] ELSE [t[1], t[3]] END, ',') AS marked FROM cut WHERE len(t) >= 4 AND t[2] <> t[1]""")
def highlight_terms(spark, sf_dir):
    """Of each benchmark text's first four tokens as a query, the second and fourth of them excluded, what is marked."""
    t = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, 4).alias("t")).where(F.size("t") == 4)
    asked = t.where(F.get("t", F.lit(1)) != F.get("t", F.lit(0))).select("query_id", F.concat(F.lit('"'), F.get("t", F.lit(0)), F.lit('" -'), F.get("t", F.lit(1)), F.lit("  "), F.get("t", F.lit(2)), F.lit(" -"), F.get("t", F.lit(3))).alias("query"))
    return asked.select("query_id", F.array_join(marked_terms(F.col("query")), ",").alias("marked"))


@query(f"""WITH {OPENS}, docs AS (SELECT doc_id AS item_id, source FROM documents)
SELECT item_id, source, coalesce(opens, 0) AS opens, last_opened_at, round(CASE WHEN max(opens) OVER (PARTITION BY source) > 1 THEN ln(1 + coalesce(opens, 0)) / ln(1 + max(opens) OVER (PARTITION BY source)) ELSE 0 END, 6) AS popularity FROM docs LEFT JOIN opens USING (item_id)""")
def popularity_norm(spark, sf_dir):
    d = V.items(spark, sf_dir).select("item_id", "source").join(V.opens(spark, sf_dir), "item_id", "left").withColumn("opens", F.coalesce("opens", F.lit(0)))
    most = d.groupBy(F.col("source").alias("_s")).agg(F.max("opens").alias("most"))
    joined = d.join(most, F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("item_id", "source", "opens", "last_opened_at", F.round(F.when(F.col("most") > 1, F.log1p("opens") / F.log1p("most")).otherwise(0.0), 6).alias("popularity"))


@query("""SELECT event_type AS term, event_id % (SELECT count(*) FROM documents) AS item_id, count(*) AS n, max(ts) AS at FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def click_learning(spark, sf_dir):
    n = V.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("docs"))
    e = V.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).crossJoin(F.broadcast(n))
    return e.groupBy(F.col("event_type").alias("term"), (F.col("event_id") % F.col("docs")).alias("item_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))


@query(f"WITH {CHUNKS}, {POSTINGS} SELECT term, sum(tf)::BIGINT AS cnt, count(*) AS df FROM postings WHERE length(term) BETWEEN 2 AND 12 GROUP BY term ORDER BY cnt DESC, term LIMIT 8000")
def vocabulary(spark, sf_dir):
    known = V.index(spark, sf_dir).terms.where(F.length("term").between(2, 12))
    return known.select("term", "cnt", "df").orderBy(F.desc("cnt"), "term").limit(8000)
