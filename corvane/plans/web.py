"""Queries around a search on the web."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import web
from corvane.functions.text import sentences
from corvane.operators import retrieval
from corvane.operators import web_search as W
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.views import queries_sql

QUERIES, ORACLE_SQL, query = registry()


def _hits(patterns):
    return " + ".join(f"regexp_matches(q, '(?i){p}')::INT" for p in patterns)


_PATTERNS = {
    "code": [r"github", r"源码", r"源代码", r"代码实现", r"repo\b", r"仓库", r"\bnpm\b", r"\bpip install\b", r"\bapi\s*(文档|reference)", r"报错", r"traceback", r"stack\s*overflow", r"怎么写", r"示例代码", r"\b(sdk|cli)\b", r"how to (implement|code)"],
    "scholar": [r"论文", r"文献", r"综述", r"研究进展", r"\barxiv\b", r"\bdoi\b", r"被引", r"期刊", r"\bpaper[s]?\b", r"survey", r"state[- ]of[- ]the[- ]art", r"\bsota\b", r"实验结果", r"数据集", r"benchmark"],
    "news": [r"最新", r"今天", r"昨天", r"最近", r"新闻", r"发布会", r"上市", r"官宣", r"爆料", r"进展如何", r"\b202\d\b", r"latest", r"breaking", r"announce", r"发布了"],
    "howto": [r"怎么", r"如何", r"教程", r"步骤", r"安装", r"配置", r"设置", r"入门", r"上手", r"\bhow to\b", r"tutorial", r"guide", r"解决", r"修复", r"排查"],
    "definition": [r"是什么", r"什么是", r"定义", r"含义", r"概念", r"原理", r"区别", r"和.{1,12}的?区别", r"\bvs\b", r"对比", r"what is\b", r"meaning of", r"difference between"],
    "product": [r"多少钱", r"价格", r"报价", r"哪个好", r"推荐", r"评测", r"参数", r"配置单", r"买", r"优惠", r"\breview\b", r"\bprice\b"],
}
_KINDS = " ".join(f"WHEN {_hits(p)} > 0 THEN '{k}'" for k, p in _PATTERNS.items())
_COUNTS = " ".join(f"WHEN {_hits(p)} > 0 THEN {_hits(p)}" for k, p in _PATTERNS.items())
_ASKED = "asked AS (SELECT doc_id, ['how to ', 'latest ', 'what is the price of ', 'arxiv paper survey ', ''][doc_id % 5 + 1] || split_part(text, ' ', 2) AS q FROM documents)"


@query(f"WITH {_ASKED}, n AS (SELECT doc_id, CASE {_KINDS} ELSE 'general' END AS kind, CASE {_COUNTS} ELSE 0 END AS hits FROM asked) SELECT doc_id, kind, CASE WHEN hits = 0 THEN 0.0::DOUBLE WHEN hits = 1 THEN 0.5::DOUBLE WHEN hits = 2 THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM n")
def web_intent(spark, sf_dir):
    start = F.element_at(F.array(*[F.lit(x) for x in ("how to ", "latest ", "what is the price of ", "arxiv paper survey ", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.concat(start, F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit(""))).alias("q"))
    return d.select("doc_id", W.intent(F.col("q")).alias("i")).select("doc_id", "i.kind", "i.confidence")


@query(f"WITH {queries_sql()} SELECT query_id, pos, query || ' ' || ['debunked', 'false claim', 'criticism'][pos + 1] AS counter FROM queries CROSS JOIN (SELECT unnest([0, 1, 2]) AS pos) WHERE trim(query) <> ''")
def counter_queries(spark, sf_dir):
    return W.counter_queries(V.queries(spark, sf_dir))


@query(f"WITH {queries_sql()} SELECT query_id, query || ' (' || array_to_string(list_transform(['gov.cn', 'gov.uk', 'europa.eu', 'who.int', 'iso.org', 'ietf.org', 'nist.gov'], lambda s: 'site:' || s), ' OR ') || ')' AS query FROM queries")
def site_preset(spark, sf_dir):
    return V.queries(spark, sf_dir).select("query_id", W.with_preset(F.col("query"), "gov").alias("query"))


@query(r"""WITH cut AS (
  SELECT doc_id, source, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1))) AS s,
    generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
clean AS (SELECT doc_id, source, k, trim(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS sentence FROM cut),
sents AS (SELECT doc_id, source, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM clean WHERE length(sentence) BETWEEN 12 AND 160 AND NOT regexp_matches(sentence, '^[#=-]')),
ok AS (SELECT *, regexp_replace(sentence, '\s+', '', 'g')[1:40] AS head FROM sents WHERE regexp_matches(sentence, '[0-9]|%|[A-Z][a-z]+ [A-Z][a-z]+|年|月|亿|万')),
once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY source, head ORDER BY doc_id, pos) = 1)
SELECT source AS topic, doc_id, pos, sentence AS text, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS rank FROM once QUALIFY rank <= 8""")
def claim_filter(spark, sf_dir):
    """Claims among all sentences of a source."""
    s = V.table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(sentences(F.col("text"), 12, 160)).alias("pos", "text"))
    found = W.claims(s.select(F.col("source").alias("topic"), F.struct("doc_id", F.col("pos").cast("long").alias("pos")).alias("id"), F.lit(1).alias("priority"), "text"))
    return found.select("topic", "id.doc_id", "id.pos", "text", "rank")


@query("SELECT p_brand AS topic, count(*) FILTER (p_partkey % 3 <> 0) AS downloads, count(*) FILTER (p_partkey % 3 = 0) AS skipped, round(count(*) FILTER (p_partkey % 3 <> 0) * 2.5::DOUBLE, 1) AS estimated_mb FROM part GROUP BY p_brand")
def harvest_plan(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.col("p_brand").alias("topic"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("https://x/"), "p_name")).alias("pdf"))
    return W.harvest_plan(p)


@query("""WITH uses AS (SELECT l_orderkey AS doc, l_partkey AS url, l_suppkey AS text, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, min(pos) OVER (PARTITION BY doc, url, text) AS first FROM uses) SELECT doc, url, dense_rank() OVER (PARTITION BY doc ORDER BY first) AS n FROM ranked""")
def citation_numbers(spark, sf_dir):
    u = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("text")).agg(F.min("l_linenumber").alias("pos"))
    return W.citation_numbers(u).select("doc", "url", "n")


@query(r"""SELECT sha1(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}]+', '', 'g'))[1:20] AS fact, count(*) AS seen, min(doc_id) AS first_seen, max(doc_id) AS last_seen, array_to_string(list_sort(list(DISTINCT source)), ',') AS topics FROM documents GROUP BY 1""")
def memory_upsert(spark, sf_dir):
    r = V.table(spark, sf_dir, "documents").select(F.col("source").alias("topic"), F.substring_index("text", "\n", 1).alias("text"), F.col("doc_id").alias("ts"))
    return W.remembered(r).withColumn("topics", F.array_join("topics", ","))


@query("""WITH f AS (SELECT event_type AS topic, sha1(regexp_replace(lower(user_id || ' saw ' || CAST(floor(value) AS BIGINT)), '[^\\p{L}\\p{N}]+', '', 'g'))[1:20] AS fact, count(*) AS seen, max(event_id) AS last_seen FROM events GROUP BY ALL)
SELECT topic, fact, seen, last_seen, row_number() OVER (PARTITION BY topic ORDER BY seen DESC, last_seen DESC, fact) AS rank FROM f QUALIFY rank <= 30""")
def memory_recall(spark, sf_dir):
    said = F.concat(F.col("user_id").cast("string"), F.lit(" saw "), F.floor("value").cast("string"))
    return W.recalled(V.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), said.alias("text"), F.col("event_id").alias("ts")))


@query("SELECT 's' || l_suppkey AS site, count(DISTINCT l_partkey) AS urls, count(DISTINCT l_orderkey) AS topics, count(*) AS hits FROM lineitem GROUP BY l_suppkey")
def site_history(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    return W.site_history(li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"), F.col("l_partkey").alias("url"), F.col("l_orderkey").alias("topic")))


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(/ad[s]?/|utm_(source|medium|campaign)=|/promo|/sponsor|/affiliate)') THEN 'ad' WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(www\\.)?[a-z0-9-]+\\.(com|cn|io|ai)$') THEN 'vendor' ELSE '' END AS interest FROM pages""")
def page_interests(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.array_join(web.interests(F.col("url")), ",").alias("interest"))


@query("""WITH runs AS (SELECT o_custkey AS project, count(*) AS runs, max(o_orderdate) AS last_run FROM orders GROUP BY 1), src AS (SELECT o_custkey AS project, count(DISTINCT l_partkey) AS sources FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS project, coalesce(runs, 0) AS runs, last_run, coalesce(sources, 0) AS sources FROM customer LEFT JOIN runs ON project = c_custkey LEFT JOIN src USING (project)""")
def project_listing(spark, sf_dir):
    o, li = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    runs = o.select(F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("ts"))
    sources = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("project"), F.col("l_partkey").alias("url"))
    return W.project_listing(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project")), runs, sources).select("project", "runs", "last_run", "sources")


@query(r"""WITH code AS (SELECT doc_id, 'def ' || lang || '_reader(x):' || chr(10) || 'class ' || source || 'Doc:' || chr(10) || '  def _hidden(): pass' || chr(10) || text AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?m)^\s*(?:def|class|func|function|CREATE TABLE)\s+([A-Za-z][A-Za-z0-9_]{2,})', 1)))[1:12], ',') AS symbols FROM code""")
def code_symbols(spark, sf_dir):
    """Whole texts under definitions named by their language and source, since the given tables hold no code."""
    t = F.concat(F.lit("def "), "lang", F.lit("_reader(x):\nclass "), "source", F.lit("Doc:\n  def _hidden(): pass\n"), "text")
    return V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(W.code_symbols(t), ",").alias("symbols"))


@query(r"SELECT doc_id, '[1](/' || doc_id || ') and [2] of ' || regexp_replace(text, 'https?://\S+', '', 'g') AS text FROM documents")
def citation_linkify(spark, sf_dir):
    """Whole texts after two marks, of which one is known."""
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", W.linked(F.concat(F.lit("[1] and [2] of "), "text"), F.create_map(F.lit("1"), F.concat(F.lit("/"), F.col("doc_id").cast("string")))).alias("text"))


@query(f"WITH {V.ITEMS} SELECT item_id, regexp_matches(locator, '(^|/)src1/.*$') OR regexp_matches(locator, '(^|/)fr/[0-9]\\.txt$') AS ignored FROM items")
def ignore_globs(spark, sf_dir):
    return V.items(spark, sf_dir).select("item_id", W.ignored(F.col("locator"), ["src1/*", "fr/?.txt"]).alias("ignored"))


@query("""WITH by_page AS (SELECT user_id AS video, CAST(floor(value) AS BIGINT) AS page, count(DISTINCT event_id % 16) AS frames FROM events GROUP BY ALL) SELECT video, page, frames, row_number() OVER (PARTITION BY video ORDER BY frames DESC, page) AS rank FROM by_page""")
def reverse_video_votes(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.floor("value").alias("page"), (F.col("event_id") % 16).alias("frame"))
    return W.votes(e)


@query(f"""WITH {V.KNN}, spaces AS (SELECT p.query_id, p.item_id, CASE WHEN u.label < 5 THEN 'image' ELSE 'scene' END AS kind, CASE WHEN u.label < 5 THEN p.item_id ELSE p.item_id // 10 END AS owner, greatest(0.0::DOUBLE, cosine) AS score FROM pairs p JOIN unit u USING (item_id)),
one AS (SELECT * FROM spaces QUALIFY kind = 'image' OR row_number() OVER (PARTITION BY query_id, kind, owner ORDER BY score DESC, item_id) = 1)
SELECT query_id, kind, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM one QUALIFY rank <= 20""")
def search_by_image(spark, sf_dir):
    """Neighbours among pictures and scenes at once; of a video, which has ten scenes, only its best: 200 neighbours hold 20 owners."""
    from pyspark.sql import Window

    v = V.vectors(spark, sf_dir)
    near = retrieval.knn(v, V.query_vectors(spark, sf_dir), 200).join(v.select("item_id", "label"), "item_id")
    kinds = near.withColumn("kind", F.when(F.col("label") < 5, "image").otherwise("scene")).withColumn("owner", F.when(F.col("label") < 5, F.col("item_id")).otherwise(F.floor(F.col("item_id") / 10))).withColumn("score", F.greatest(F.lit(0.0), "cosine"))
    one = kinds.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "kind", "owner").orderBy(F.desc("score"), "item_id"))).where("kind = 'image' OR r = 1").drop("rank", "r")
    return retrieval.top(one.select("query_id", "kind", "item_id", "score"), 20, F.desc("score"), F.col("item_id"))
