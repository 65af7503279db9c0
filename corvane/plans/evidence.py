"""Queries on folded results, trust, agreement and conflict, bibliographic records, and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import web
from corvane.functions.text import tokens
from corvane.operators import answers, clustering, compare, retrieval, spelling, vector_index
from corvane.operators import evidence as E
from corvane.operators.passages import tfidf
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.retrieval import _BASE, _BEST, _bm25
from corvane.plans.texts import _TFIDF
from corvane.plans.views import CHUNKS, POSTINGS, TOKENS, queries_sql
from corvane.tables import written

QUERIES, ORACLE_SQL, query = registry()

_RESULTS = r"""base AS (
  SELECT page_id, url, page_id % 20 AS query_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^[A-Za-z]+://(www\.)?', '') AS canonical, 'about ' || (page_id % 40) AS snippet FROM pages),
results AS (SELECT query_id, page_id, engine, 1 + (page_id * 13 + engine * 5) % 10 AS pos, regexp_replace(canonical, '/+$', '') AS canonical, url, title, snippet, site FROM base CROSS JOIN (SELECT unnest([0, 1, 2]) AS engine) WHERE (page_id * 7 + engine) % 3 <> 0)"""


def _results(spark, sf_dir):
    """Pages as the results of three engines for twenty queries."""
    p = V.table(spark, sf_dir, "pages").withColumn("engine", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where((F.col("page_id") * 7 + F.col("engine")) % 3 != 0)
    plain = F.regexp_replace(F.regexp_replace(F.substring_index(F.substring_index("url", "#", 1), "?", 1), r"^[A-Za-z]+://(www\.)?", ""), "/+$", "")
    return p.select((F.col("page_id") % 20).alias("query_id"), "page_id", "engine", (1 + (F.col("page_id") * 13 + F.col("engine") * 5) % 10).alias("pos"), plain.alias("canonical"), "url", web.html_title(F.col("html")).alias("title"), F.concat(F.lit("about "), (F.col("page_id") % 40).cast("string")).alias("snippet"), web.host(F.col("url")).alias("site"))


_FOLD = rf"""{_RESULTS}, once AS (
  SELECT query_id, canonical, arg_max(title, (length(snippet), canonical, snippet, title)) AS title, arg_max(snippet, (length(snippet), canonical, snippet, title)) AS snippet FROM results GROUP BY ALL),
keyed AS (SELECT *, CASE WHEN length(title) >= 6 AND length(trim(snippet)) > 0 THEN sha1(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g')[1:60] || '|' || regexp_replace(lower(snippet), '[^\p{{L}}\p{{N}}]+', '', 'g')[1:40]) ELSE sha1(canonical) END AS key FROM once),
ranks AS (SELECT r.query_id, key, engine, site, min(pos) AS pos FROM results r JOIN keyed USING (query_id, canonical) GROUP BY ALL),
engines AS (SELECT query_id, key, engine, min(pos) AS pos FROM ranks GROUP BY ALL),
scored AS (SELECT query_id, key, round(sum(1.0::DOUBLE / (60 + pos)), 8) AS score, count(*) AS engines FROM engines GROUP BY ALL),
sites AS (SELECT query_id, key, count(DISTINCT site) AS sites FROM ranks GROUP BY ALL),
named AS (SELECT query_id, key, arg_max(title, (length(snippet), canonical)) AS title FROM keyed GROUP BY ALL),
folded AS (SELECT query_id, key, title, engines, sites, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, key) AS rank FROM named JOIN scored USING (query_id, key) JOIN sites USING (query_id, key))"""


@query(f"WITH {_FOLD} SELECT * FROM folded")
def title_fold_rrf(spark, sf_dir):
    return E.fold(_results(spark, sf_dir)).select("query_id", "key", "title", "engines", "sites", "score", "rank")


@query(f"""{_BASE}, {_BEST}, {_FOLD},
lists AS (SELECT query_id, 'local' AS origin, CAST(item_id AS VARCHAR) AS key, rank FROM keyword UNION ALL SELECT query_id, 'web', key, rank FROM folded)
SELECT query_id, origin, key, rank, count(*) OVER (PARTITION BY query_id, origin) AS listed FROM lists WHERE rank <= 10""")
def unified_list(spark, sf_dir):
    """What the library has on a query beside what the web has, ten of each."""
    local = retrieval.best_chunks(_bm25(spark, sf_dir)).select("query_id", F.lit("local").alias("origin"), F.col("item_id").cast("string").alias("key"), "rank")
    outside = E.fold(_results(spark, sf_dir)).select("query_id", F.lit("web").alias("origin"), "key", "rank")
    few = local.unionByName(outside).where("rank <= 10")
    return few.join(few.groupBy("query_id", "origin").agg(F.count(F.lit(1)).alias("listed")), ["query_id", "origin"])


_CLUSTERS = """clusters AS (
  SELECT page_id AS item_id, page_id % 20 AS query_id, ['official', 'academic', 'mainstream', 'community', 'unknown', 'low'][page_id % 6 + 1] AS tier, 1 + page_id % 4 AS sites, page_id % 5 AS n_flags,
    page_id % 7 = 0 AS ai_suspect, page_id * 13 % 2000 AS age_days, page_id % 31 = 0 AS blocked, 1.0::DOUBLE / (60 + page_id % 17) AS relevance FROM pages),
raw AS (SELECT *, least(1.0::DOUBLE, CASE tier WHEN 'official' THEN 1.0::DOUBLE WHEN 'academic' THEN 0.95::DOUBLE WHEN 'mainstream' THEN 0.75::DOUBLE WHEN 'community' THEN 0.55::DOUBLE WHEN 'unknown' THEN 0.45::DOUBLE ELSE 0.12::DOUBLE END
    + CASE WHEN sites >= 3 THEN 0.15::DOUBLE WHEN sites <= 1 AND tier IN ('unknown', 'community', 'low') THEN -0.08::DOUBLE ELSE 0 END)
    - CASE WHEN n_flags > 0 THEN least(0.45::DOUBLE, 0.10::DOUBLE * pow(n_flags, 1.4::DOUBLE)) ELSE 0 END - CASE WHEN ai_suspect THEN 0.12::DOUBLE ELSE 0 END - CASE WHEN age_days > 1095 THEN 0.10::DOUBLE ELSE 0 END AS s FROM clusters),
trusted AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s)), 6) AS trust, blocked OR (n_flags >= 3 AND tier IN ('unknown', 'low')) AS hide FROM raw)"""


def _trusted(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages").select("page_id")
    tiers = F.array(*[F.lit(t) for t in ("official", "academic", "mainstream", "community", "unknown", "low")])
    i = F.col("page_id")
    c = p.select(i.alias("item_id"), (i % 20).alias("query_id"), F.element_at(tiers, (i % 6 + 1).cast("int")).alias("tier"), (1 + i % 4).alias("sites"), F.slice(F.array(*[F.lit(f) for f in list(web.FARM_WEIGHTS)[:4]]), F.lit(1), (i % 5).cast("int")).alias("farm_flags"), (i % 7 == 0).alias("ai_suspect"), (i * 13 % 2000).alias("age_days"), (i % 31 == 0).alias("blocked"), (1.0 / (60 + i % 17)).alias("relevance"))
    return E.trust(c)


@query(f"WITH {_CLUSTERS} SELECT item_id, tier, trust, hide FROM trusted")
def trust_score(spark, sf_dir):
    return _trusted(spark, sf_dir).select("item_id", "tier", "trust", "hide")


@query(f"""WITH {_CLUSTERS}, f AS (SELECT *, round(0.65::DOUBLE * relevance / max(relevance) OVER (PARTITION BY query_id) + 0.35::DOUBLE * trust, 6) AS final FROM trusted)
SELECT query_id, item_id, hide, final, row_number() OVER (PARTITION BY query_id, hide ORDER BY final DESC, item_id) AS rank FROM f""")
def rank_with_trust(spark, sf_dir):
    return E.rank_with_trust(_trusted(spark, sf_dir)).select("query_id", "item_id", "hide", "final", "rank")


@query(f"WITH {_CLUSTERS} SELECT tier, hide, count(*) AS n, round(avg(trust), 6) AS trust FROM trusted GROUP BY tier, hide")
def tier_histogram(spark, sf_dir):
    return _trusted(spark, sf_dir).groupBy("tier", "hide").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("trust"), 6).alias("trust"))


@query("""WITH posts AS (SELECT event_id AS post_id, event_type AS topic, 's' || user_id AS site, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour FROM events),
active AS (SELECT DISTINCT topic, site, hour FROM posts), hours AS (SELECT DISTINCT topic, hour FROM posts),
ends AS (SELECT h.topic, h.hour FROM hours h JOIN active a ON a.topic = h.topic AND a.hour BETWEEN h.hour - 2 AND h.hour GROUP BY ALL HAVING count(DISTINCT site) >= 10)
SELECT topic, post_id FROM posts p WHERE EXISTS (SELECT 1 FROM ends e WHERE e.topic = p.topic AND e.hour BETWEEN p.hour AND p.hour + 2)""")
def burst_sites(spark, sf_dir):
    """Ten sites within two hours, since the given events come close together."""
    e = V.table(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    return E.bursts(e.select(F.col("event_id").alias("post_id"), F.col("event_type").alias("topic"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("site"), hour.alias("hour")), 2, 10)


@query(rf"WITH {_RESULTS} SELECT regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS title_key, count(DISTINCT site) AS sites FROM results GROUP BY 1 HAVING count(DISTINCT site) >= 3")
def clone_titles(spark, sf_dir):
    return E.clones(_results(spark, sf_dir))


_EVIDENCE = """said AS (SELECT 'c' || user_id || '-' || strftime(ts, '%m-%d') AS claim, 's' || CAST(extract(hour FROM ts) // 6 AS BIGINT) AS site, CASE event_type WHEN 'purchase' THEN 'support' WHEN 'signup' THEN 'support' WHEN 'error' THEN 'refute' ELSE 'neutral' END AS stance FROM events)"""


def _evidence(spark, sf_dir):
    """What was said of a user's day stands for a claim, and a quarter of the day for a site."""
    t = F.col("event_type")
    claim = F.concat(F.lit("c"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "MM-dd"))
    return V.table(spark, sf_dir, "events").select(claim.alias("claim"), F.concat(F.lit("s"), F.floor(F.hour("ts") / 6).cast("string")).alias("site"), F.when(t.isin("purchase", "signup"), "support").when(t == "error", "refute").otherwise("neutral").alias("stance"))


_VERDICTS = f"""{_EVIDENCE}, by_claim AS (SELECT claim, count(DISTINCT site) FILTER (stance = 'support') AS support_sites, count(DISTINCT site) FILTER (stance = 'refute') AS refute_sites,
  count(*) FILTER (stance = 'support') AS support, count(*) FILTER (stance = 'refute') AS refute FROM said GROUP BY claim),
judged AS (SELECT *, CASE WHEN refute_sites >= 1 THEN 'disputed' WHEN support_sites >= 2 THEN 'supported' WHEN support_sites = 1 THEN 'weak' ELSE 'unverified' END AS verdict,
  CASE WHEN support + refute > 0 THEN CAST(round((1 - abs(support - refute) / (support + refute)::DOUBLE) * least(1.0::DOUBLE, (support + refute) / 6.0::DOUBLE) * 100, 0) AS BIGINT) END AS controversy FROM by_claim)"""


@query(f"WITH {_VERDICTS} SELECT claim, support_sites, refute_sites, verdict FROM judged")
def claim_verdict(spark, sf_dir):
    return E.verdicts(_evidence(spark, sf_dir)).select("claim", "support_sites", "refute_sites", "verdict")


@query(f"WITH {_VERDICTS} SELECT claim, support, refute, controversy, CASE WHEN support + refute = 0 THEN 'unknown' WHEN controversy >= 60 THEN 'high' WHEN controversy >= 30 THEN 'medium' ELSE 'low' END AS level FROM judged")
def controversy(spark, sf_dir):
    return E.verdicts(_evidence(spark, sf_dir)).select("claim", "support", "refute", "controversy", "level")


@query(f"""WITH {_EVIDENCE}, cells AS (SELECT claim AS topic, site, max((stance = 'support')::INT) AS s, max((stance = 'refute')::INT) AS r FROM said GROUP BY ALL),
named AS (SELECT topic, site, CASE WHEN s = 1 AND r = 1 THEN 'mixed' WHEN s = 1 THEN 'positive' WHEN r = 1 THEN 'negative' ELSE 'neutral' END AS said FROM cells)
SELECT topic, coalesce(max(said) FILTER (site = 's0'), 'silent') AS s0, coalesce(max(said) FILTER (site = 's1'), 'silent') AS s1, coalesce(max(said) FILTER (site = 's2'), 'silent') AS s2, coalesce(max(said) FILTER (site = 's3'), 'silent') AS s3
FROM (SELECT DISTINCT claim AS topic FROM said) LEFT JOIN named USING (topic) GROUP BY topic""")
def consensus_matrix(spark, sf_dir):
    return E.matrix(_evidence(spark, sf_dir).withColumnRenamed("claim", "topic"), ["s0", "s1", "s2", "s3"])


@query("""WITH m AS (SELECT l_partkey AS topic, 'd' || o_orderkey % 50 AS site, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'official' ELSE 'community' END AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
firsts AS (SELECT topic, arg_min(site, (day, site)) AS first_site, min(day) AS first_day, max(day) - min(day) AS days, count(day) AS n, arg_min(tier, (day, site)) AS first_tier FROM (SELECT topic, site, day, min(tier) AS tier FROM m GROUP BY ALL) GROUP BY topic)
SELECT topic, first_site, first_day, days, n, CASE WHEN n >= 5 AND days <= 3 THEN 'burst' WHEN n >= 3 AND first_tier IN ('unknown', 'low', 'community') THEN 'weak_origin' ELSE 'traced' END AS kind FROM firsts""")
def origin_trace(spark, sf_dir):
    li, o = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "orders")
    m = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_partkey").alias("topic"), F.concat(F.lit("d"), (F.col("o_orderkey") % 50).cast("string")).alias("site"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 3 == 0, "low").when(F.col("o_orderkey") % 3 == 1, "official").otherwise("community").alias("tier"))
    return E.origin(m.groupBy("topic", "site", "day").agg(F.min("tier").alias("tier")))


@query(f"""WITH {_RESULTS}, owned AS (SELECT query_id AS topic, array_to_string(string_split(site, '.')[-2:], '.') || page_id % 3 AS owner FROM results), by_topic AS (SELECT topic, count(*) AS results, count(DISTINCT owner) AS owners FROM owned GROUP BY topic)
SELECT topic, results, owners, CASE WHEN owners <= 1 THEN 'single' WHEN owners * 2 <= results THEN 'concentrated' ELSE 'independent' END AS verdict FROM by_topic""")
def site_independence(spark, sf_dir):
    r = _results(spark, sf_dir).select(F.col("query_id").alias("topic"), F.concat(web.registrable(F.col("site")), (F.col("page_id") % 3).cast("string")).alias("owner"))
    return E.independence(r)


_DATED = """dated AS (SELECT l_orderkey AS topic, 'd' || l_suppkey AS site, CAST(min(l_shipdate) AS DATE) AS day, CASE WHEN l_suppkey % 3 = 0 THEN 'month' ELSE 'day' END AS precision FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_DATED}, gaps AS (SELECT x.topic, x.site AS a, y.site AS b, abs(CASE WHEN x.precision = 'month' OR y.precision = 'month' THEN CAST(date_trunc('month', x.day) AS DATE) - CAST(date_trunc('month', y.day) AS DATE) ELSE x.day - y.day END) AS days
  FROM dated x JOIN dated y ON x.topic = y.topic AND x.site < y.site) SELECT topic, a, b, days FROM gaps WHERE days >= 2""")
def date_conflicts(spark, sf_dir):
    d = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("topic"), F.col("l_suppkey")).agg(F.to_date(F.min("l_shipdate")).alias("day"))
    return E.date_conflicts(d.select("topic", F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("site"), "day", F.when(F.col("l_suppkey") % 3 == 0, "month").otherwise("day").alias("precision")))


@query("""WITH claimed AS (SELECT DISTINCT o_orderkey AS key, o_totalprice AS value FROM orders), sourced AS (SELECT l_orderkey AS key, l_extendedprice * 1.0 AS value FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT o_orderkey, o_totalprice * (1 + (o_orderkey % 4) * 0.003::DOUBLE) FROM orders WHERE o_orderstatus = 'F')
SELECT key, value, CASE WHEN EXISTS (SELECT 1 FROM sourced s WHERE s.key = c.key AND abs(c.value - s.value) <= 0.005::DOUBLE * abs(c.value)) THEN 'ok' WHEN EXISTS (SELECT 1 FROM sourced s WHERE s.key = c.key) THEN 'mismatch' ELSE 'unverified' END AS status FROM claimed c""")
def number_check(spark, sf_dir):
    """Every order's total against the prices of its returned lines and, of finished orders, a total told again with a deviation."""
    o, li = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    claimed = o.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value"))
    sourced = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value"))
    return E.number_check(claimed, sourced.unionAll(o.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 4) * F.lit(0.003)))))


_FOUND = f"""{_BASE}, hits AS (SELECT query_id AS topic, chunk_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM bm25) WHERE r <= 50)"""


def _found(spark, sf_dir):
    """(topic, chunk_id, item_id, text): the first fifty chunks of each query, which is what a topic is here."""
    hits = retrieval.top(_bm25(spark, sf_dir), 50, F.desc("score"), F.col("chunk_id")).select(F.col("query_id").alias("topic"), "chunk_id", "item_id")
    return hits.join(V.chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id")


@query(f"""{_FOUND}, sents AS (SELECT topic, chunk_id AS id, 's' || h.item_id % 9 AS site, text || CASE WHEN h.item_id % 2 = 0 THEN ' never' ELSE '' END AS text FROM hits h JOIN chunks USING (chunk_id) WHERE length(text) BETWEEN 40 AND 400),
terms AS (SELECT DISTINCT topic, id, site, regexp_matches(text, '(不|没|无|非|未)') OR regexp_matches(text, '(?i)(\\bnot\\b|\\bno\\b|\\bnever\\b|n''t\\b)') AS negated, unnest({TOKENS.format('text')}) AS term FROM sents),
kept AS (SELECT * FROM terms WHERE length(term) >= 4), size AS (SELECT id, count(DISTINCT term) AS n FROM kept GROUP BY id),
met AS (SELECT x.topic, x.id AS a, y.id AS b, count(*) AS shared FROM kept x JOIN kept y ON x.topic = y.topic AND x.term = y.term AND x.site <> y.site AND x.negated AND NOT y.negated GROUP BY ALL)
SELECT topic, a, b, shared FROM met JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE shared >= 0.55::DOUBLE * least(p.n, q.n)""")
def conflict_pairs(spark, sf_dir):
    """Among a query's chunks; an even item's text is negated, since the given texts say nothing."""
    c = _found(spark, sf_dir).where(F.length("text").between(40, 400))
    s = c.select("topic", F.col("chunk_id").alias("id"), F.concat(F.lit("s"), (F.col("item_id") % 9).cast("string")).alias("site"), F.concat("text", F.when(F.col("item_id") % 2 == 0, " never").otherwise("")).alias("text"))
    return E.conflicts(s)


@query(rf"""{_FOUND}, told AS (SELECT topic AS corpus, chunk_id AS id, 's' || h.item_id % 13 AS site, text || CASE WHEN h.item_id % 3 = 0 THEN ' not ' WHEN h.item_id % 3 = 1 THEN ' no, never ' ELSE '' END AS text, list_filter({TOKENS.format('text')}, lambda t: length(t) >= 5)[1] AS topic FROM hits h JOIN chunks USING (chunk_id)),
said AS (SELECT corpus, topic, site, count(*) AS n, sum(len(regexp_extract_all(text, '(?i)(不|没|无|非|未|\bnot\b|\bno\b|\bnever\b|n''t\b)'))) AS negations FROM told WHERE topic IS NOT NULL GROUP BY ALL),
sites AS (SELECT corpus, site, row_number() OVER (PARTITION BY corpus ORDER BY sum(n) DESC, site) AS place FROM said GROUP BY corpus, site QUALIFY place <= 10),
cells AS (SELECT corpus, topic, site, place, CASE WHEN n IS NULL THEN 'silent' WHEN negations >= 2 THEN 'negative' WHEN negations = 1 THEN 'mixed' ELSE 'positive' END AS stance FROM (SELECT DISTINCT corpus, topic FROM said) JOIN sites USING (corpus) LEFT JOIN said USING (corpus, topic, site))
SELECT *, bool_or(stance = 'positive') OVER w AND bool_or(stance = 'negative') OVER w AS disagree FROM cells WINDOW w AS (PARTITION BY corpus, topic)""")
def agreement_matrix(spark, sf_dir):
    """What the ten most heard sites of each query's chunks hold of each topic, which is a chunk's first long word; negations are added by item."""
    c, i = _found(spark, sf_dir), F.col("item_id") % 3
    text = F.concat("text", F.when(i == 0, " not ").when(i == 1, " no, never ").otherwise(""))
    told = c.select(F.col("topic").alias("corpus"), F.col("chunk_id").alias("id"), F.concat(F.lit("s"), (F.col("item_id") % 13).cast("string")).alias("site"), text.alias("text"), F.get(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 5), F.lit(0)).alias("topic"))
    return E.stances(told.where("topic is not null"))


@query(rf"""{_FOUND}, asked AS (SELECT item_id AS claim, 's' || item_id % 13 AS own, list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 2)) AS terms FROM benchmark),
met AS (SELECT claim, 's' || h.item_id % 13 AS site, terms, text FROM hits h JOIN chunks USING (chunk_id) JOIN asked ON claim = h.topic WHERE 's' || h.item_id % 13 <> own),
judged AS (SELECT claim, site, CASE WHEN regexp_matches(text, '(?i)(辟谣|谣言|不实|假的|误传|误读|纠正|更正|澄清|撤稿|撤回|被推翻|并不|其实不|debunk|false|hoax|myth|misleading|retract|incorrect|not true|refut)') THEN 'refute'
  WHEN regexp_matches(text, '(?i)(证实|确认|属实|已验证|官方回应.{{0,6}}属实|research shows|confirmed|verified|study finds|according to)') OR len(list_filter(terms, lambda t: list_contains({TOKENS.format('text')}, t))) / len(terms)::DOUBLE >= 0.45::DOUBLE THEN 'support' ELSE 'neutral' END AS stance FROM met)
SELECT claim, stance, count(*) AS n, count(DISTINCT site) AS sites FROM judged GROUP BY claim, stance""")
def claim_checks(spark, sf_dir):
    """Each benchmark text as a claim against the chunks that its words find, those of its own site left out."""
    from corvane.operators import web_search

    claimed = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), "text", F.concat(F.lit("s"), (F.col("item_id") % 13).cast("string")).alias("site"))
    results = _found(spark, sf_dir).select(F.col("topic").alias("claim"), F.concat(F.lit("s"), (F.col("item_id") % 13).cast("string")).alias("site"), "text")
    return web_search.verify(claimed, results).groupBy("claim", "stance").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site").alias("sites"))


_NUMBERS = """claimed AS (SELECT DISTINCT o_orderkey AS key, o_totalprice AS value FROM orders), sourced AS (SELECT l_orderkey AS key, l_extendedprice * 1.0 AS value FROM lineitem)"""


@query(f"""WITH {_NUMBERS}, open AS (SELECT * FROM claimed c WHERE value <> 0 AND EXISTS (SELECT 1 FROM sourced s WHERE s.key = c.key) AND NOT EXISTS (SELECT 1 FROM sourced s WHERE s.key = c.key AND abs(c.value - s.value) <= 0.005::DOUBLE * abs(c.value))),
met AS (SELECT DISTINCT o.key, o.value, s.value AS other, abs(s.value - o.value) / abs(o.value) AS gap FROM open o JOIN sourced s ON s.key = o.key WHERE abs(s.value - o.value) / abs(o.value) <= 0.5::DOUBLE),
ranked AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY key, value ORDER BY gap, other) <= 4)
SELECT o.key, o.value, coalesce(array_to_string(list(round(other, 2)::VARCHAR ORDER BY gap, other) FILTER (other IS NOT NULL), ','), '') AS near FROM open o LEFT JOIN ranked r ON r.key = o.key AND r.value = o.value GROUP BY o.key, o.value""")
def number_near(spark, sf_dir):
    """Order totals that none of their lines has, with the lines' prices that come nearest."""
    o, li = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem")
    found = E.near_numbers(o.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("value")), li.select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("value")))
    return found.withColumn("near", F.array_join(F.transform("near", lambda x: F.round(x, 2).cast("string")), ","))


_RECORDS = r"""records AS (SELECT p_partkey AS record_id, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '10.48550/arXiv.' ELSE '10.1/' END || p_size || p_brand END AS doi, 's' || p_partkey % 4 AS source, p_type AS abstract, p_size AS citations,
  CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size END AS year, DATE '2020-01-01' + p_size AS day FROM part)"""


def _records(spark, sf_dir):
    i = F.col("p_partkey")
    doi = F.when(i % 3 == 0, F.concat(F.when(i % 2 == 0, "10.48550/arXiv.").otherwise("10.1/"), F.col("p_size").cast("string"), "p_brand"))
    return V.table(spark, sf_dir, "part").select(i.alias("record_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), doi.alias("doi"), F.concat(F.lit("s"), (i % 4).cast("string")).alias("source"), F.col("p_type").alias("abstract"), F.col("p_size").alias("citations"), F.when(i % 5 != 0, 1990 + F.col("p_size")).alias("year"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("p_size")).alias("day"))


@query(rf"""WITH {_RECORDS}, keyed AS (SELECT *, coalesce('doi:' || lower(doi), 't:' || regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g')[1:90]) AS key FROM records)
SELECT key, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, arg_max(abstract, (length(abstract), record_id)) AS abstract, max(citations) AS citations, arg_min(year, record_id) FILTER (year IS NOT NULL) AS year, count(*) AS copies FROM keyed GROUP BY key""")
def scholar_merge(spark, sf_dir):
    return E.merge_records(_records(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(rf"""WITH {_RECORDS}, n AS (SELECT *, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g')[1:90] AS norm FROM records)
SELECT record_id, CASE WHEN length(norm) >= 10 THEN min(CASE WHEN doi IS NOT NULL AND NOT contains(lower(doi), 'arxiv') THEN record_id END) OVER (PARTITION BY norm) END AS formal_id, CASE WHEN length(norm) >= 10 THEN min(day) OVER (PARTITION BY norm) ELSE day END AS first_day FROM n""")
def preprint_merge(spark, sf_dir):
    return E.merge_preprints(_records(spark, sf_dir)).select("record_id", "formal_id", "first_day")


def _corpora(spark, sf_dir):
    """(corpus, id, term, weight): TF-IDF vectors of length one of the first twenty items of each query, which are a corpus.

    Terms are weighed against all items, so all counts are read anyway, and neither postings nor a table of all items' terms is written for it.
    """
    hits = retrieval.best_chunks(_bm25(spark, sf_dir, once=True)).where("rank <= 20").select(F.col("query_id").alias("corpus"), F.col("item_id").alias("id"))
    hits = written(hits, "hits")
    index = V.index(spark, sf_dir)
    t = written(tfidf(index.item_terms(hits), V.table(spark, sf_dir, "documents"), only=hits, df=index.item_frequencies()), "hit_terms")
    norm = t.groupBy("id").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))
    return hits.join(t, "id").join(norm, "id").select("corpus", "id", "term", (F.col("tfidf") / F.col("norm")).alias("weight"))


@query()
def tfidf_cluster(spark, sf_dir):
    """Clusters among the first twenty items of each query."""
    return clustering.clusters(_corpora(spark, sf_dir))


@query()
def cluster_labels(spark, sf_dir):
    """The clusters of each query's first twenty items with labels, outliers and representatives; views stand for citations."""
    facts = V.items(spark, sf_dir).select(F.col("item_id").alias("id"), F.year("content_time").alias("year")).join(V.opens(spark, sf_dir).select(F.col("item_id").alias("id"), F.col("opens").alias("citations")), "id", "left")
    found = clustering.cluster_table(_corpora(spark, sf_dir).join(facts, "id"))
    return found.withColumns({"keywords": F.array_join("keywords", ","), "members": F.array_join(F.transform("members", lambda m: m.cast("string")), ",")})


_WEIGHED = _TFIDF.replace("df AS (SELECT term", "df2 AS (SELECT term").replace("JOIN df USING", "JOIN df2 USING")


@query(f"""{_BASE}, {_BEST}, {_WEIGHED}, norms AS (SELECT id, sqrt(sum(tfidf * tfidf)) AS norm FROM tfidf GROUP BY id),
v AS (SELECT query_id AS corpus, id, term, tfidf / norm AS w FROM keyword k JOIN tfidf ON id = k.item_id JOIN norms USING (id) WHERE k.rank <= 20)
SELECT x.corpus, x.id AS a, y.id AS b, round(sum(x.w * y.w), 6) AS cosine FROM v x JOIN v y ON x.corpus = y.corpus AND x.term = y.term AND x.id < y.id GROUP BY ALL""")
def tfidf_cosines(spark, sf_dir):
    v = _corpora(spark, sf_dir)
    x, y = v.alias("x"), v.alias("y")
    met = x.join(y, (F.col("x.corpus") == F.col("y.corpus")) & (F.col("x.term") == F.col("y.term")) & (F.col("x.id") < F.col("y.id")))
    return met.groupBy(F.col("x.corpus").alias("corpus"), F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.round(F.sum(F.col("x.weight") * F.col("y.weight")), 6).alias("cosine"))


@query()
def topic_building(spark, sf_dir):
    """Topics among the first fifty chunks of each query."""
    c = _found(spark, sf_dir).where(F.length("text").between(12, 400))
    s = c.select(F.col("topic").alias("corpus"), F.col("chunk_id").alias("id"), F.concat(F.lit("s"), (F.col("item_id") % 9).cast("string")).alias("site"), F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 5)).alias("terms"))
    return E.topics(s)


_COVERED = rf"""{_BASE}, {_BEST}, hits AS (SELECT k.query_id, k.item_id, k.chunk_id, k.rank, c.text, q.terms FROM keyword k JOIN chunks c USING (chunk_id) JOIN (SELECT query_id, list_distinct(terms) AS terms FROM queries) q USING (query_id) WHERE k.rank <= 4),
pieces AS (SELECT query_id, item_id, chunk_id, rank, terms, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1))) AS s,
  generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1)), 1) AS k FROM hits),
clean AS (SELECT *, trim(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS sentence FROM pieces),
sents AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY k) AS i, round(len(list_filter(terms, lambda t: contains(strip_accents(lower(sentence)), t))) / len(terms)::DOUBLE, 3) AS coverage FROM clean WHERE length(sentence) BETWEEN 8 AND 160 AND NOT regexp_matches(sentence, '^[#=-]'))"""


def _covered(spark, sf_dir, ranks: int = 4):
    c = V.chunks(spark, sf_dir)
    hits = retrieval.best_chunks(_bm25(spark, sf_dir)).where(F.col("rank") <= ranks)
    q = V.queries(spark, sf_dir).select("query_id", "terms")
    joined = hits.join(c.select("chunk_id", "text"), "chunk_id").join(q, "query_id")
    return answers.covered_sentences(joined).join(hits.select("query_id", "chunk_id", "item_id", "rank"), ["query_id", "chunk_id"])


@query(rf"""{_COVERED}, ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY coverage DESC, i) AS r FROM sents WHERE coverage >= 0.5 AND rank = 1)
SELECT query_id, chunk_id, string_agg(sentence, ' ' ORDER BY i) AS answer, max(coverage) AS coverage FROM ok WHERE r <= 2 GROUP BY ALL""")
def answer_card(spark, sf_dir):
    return answers.answer_cards(_covered(spark, sf_dir, 1))


@query(rf"""{_COVERED}, ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY coverage DESC, chunk_id, i) AS r FROM sents WHERE coverage >= 0.3)
SELECT query_id, item_id, chunk_id, sentence, coverage FROM ok WHERE r <= 2""")
def ask_passages(spark, sf_dir):
    return answers.passages(_covered(spark, sf_dir)).select("query_id", "item_id", "chunk_id", "sentence", "coverage")


@query()
def ask_distinct_passages(spark, sf_dir):
    p = answers.passages(_covered(spark, sf_dir))
    return E.distinct_passages(p.select("query_id", F.xxhash64("chunk_id", "i").alias("id"), F.col("coverage").alias("score"), F.col("sentence").alias("text")))


@query(rf"""WITH {CHUNKS}, kinds AS (SELECT item_id, chunk_id, CASE WHEN regexp_matches(lower(text), '( is (a|an|the) | means | refers to |是指|定义为)') THEN 'define' WHEN regexp_matches(lower(text), '(found that|results show|shows that|发现|表明)') THEN 'finding'
  WHEN regexp_matches(lower(text), '(method|approach|using |方法|采用)') THEN 'method' WHEN regexp_matches(lower(text), '( than |compared|versus|相比|优于)') THEN 'compare' WHEN regexp_matches(lower(text), '[0-9]+(\.[0-9]+)?%?') THEN 'number' END AS kind FROM chunks),
ranked AS (SELECT item_id, kind, chunk_id, row_number() OVER (PARTITION BY item_id, kind ORDER BY chunk_id) AS rank FROM kinds WHERE kind IS NOT NULL) SELECT * FROM ranked WHERE rank <= 2""")
def doc_questions(spark, sf_dir):
    return answers.questions(V.chunks(spark, sf_dir))


@query(f"""WITH {V.ITEMS}, f AS (SELECT modality = 'fr' AS lang, source = 'src1' AS src, size_bytes > 20000 AS size FROM items)
SELECT 'lang' AS dropped, count(*) FILTER (src AND size) AS n FROM f UNION ALL SELECT 'src', count(*) FILTER (lang AND size) FROM f UNION ALL SELECT 'size', count(*) FILTER (lang AND src) FROM f UNION ALL SELECT 'none', count(*) FILTER (lang AND src AND size) FROM f""")
def recovery_drop_filter(spark, sf_dir):
    return answers.drop_one(V.items(spark, sf_dir), {"lang": F.col("modality") == "fr", "src": F.col("source") == "src1", "size": F.col("size_bytes") > 20000})


@query(f"WITH {CHUNKS}, {POSTINGS}, {queries_sql(3)} SELECT query_id, q.term, count(chunk_id) AS n FROM query_terms q LEFT JOIN postings p ON p.term = q.term GROUP BY query_id, q.term")
def recovery_split_terms(spark, sf_dir):
    terms = V.query_terms(spark, sf_dir, 3)
    return answers.split_terms(V.index(spark, sf_dir).terms, terms)


_VOCAB = f"""{CHUNKS}, {POSTINGS}, vocab AS (SELECT term, sum(tf)::BIGINT AS cnt FROM postings WHERE length(term) BETWEEN 2 AND 12 GROUP BY term),
asked AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}[1:3]) AS t, generate_subscripts({TOKENS.format('text')}[1:3], 1) AS nth FROM benchmark),
typed AS (SELECT query_id, nth, CASE WHEN nth <> 1 + query_id % 3 THEN t ELSE CASE query_id % 4 WHEN 0 THEN t[1:length(t) - 1] WHEN 1 THEN 'q' || t[2:length(t) - 1] || 'z' WHEN 2 THEN t[1:1] || 'x' || t[2:] ELSE t[2:] || t[1:1] END END AS term FROM asked),
unknown AS (SELECT DISTINCT term, CASE WHEN length(term) <= 3 THEN 1 ELSE 2 END AS most FROM typed WHERE length(term) BETWEEN 2 AND 12 AND term NOT IN (SELECT term FROM vocab)),
plain AS (SELECT term, cnt, translate(term, 'ßœæøłđðþıħ', 'SOEUABCDFH') AS bytes FROM vocab),
near AS (SELECT u.term, v.term AS suggestion, levenshtein(translate(u.term, 'ßœæøłđðþıħ', 'SOEUABCDFH'), bytes) AS distance, cnt FROM unknown u JOIN plain v ON abs(length(u.term) - length(v.term)) <= most AND levenshtein(translate(u.term, 'ßœæøłđðþıħ', 'SOEUABCDFH'), bytes) <= most),
meant AS (SELECT term, suggestion, distance, cnt FROM near QUALIFY row_number() OVER (PARTITION BY term ORDER BY cnt DESC, distance, suggestion) = 1)"""


def _typed(spark, sf_dir):
    """(query_id, nth, term): the first three tokens of each benchmark item, one of them misspelt: cut, changed at both ends, with a letter put in, or with the first one moved to the end."""
    read = V.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(F.slice(tokens(F.col("text")), 1, 3)).alias("at", "t"))
    kind, size = F.col("query_id") % 4, F.length("t")
    wrong = (
        F.when(kind == 0, F.substring("t", F.lit(1), size - 1)).when(kind == 1, F.concat(F.lit("q"), F.substring("t", F.lit(2), size - 2), F.lit("z")))
        .when(kind == 2, F.concat(F.substring("t", 1, 1), F.lit("x"), F.substring("t", F.lit(2), size))).otherwise(F.concat(F.substring("t", F.lit(2), size), F.substring("t", 1, 1)))
    )
    return read.select("query_id", (F.col("at") + 1).alias("nth"), F.when(F.col("at") != F.col("query_id") % 3, F.col("t")).otherwise(wrong).alias("term"))


@query(f"WITH {_VOCAB} SELECT term, suggestion, distance, cnt FROM meant")
def recovery_did_you_mean(spark, sf_dir):
    return spelling.suggestions(_typed(spark, sf_dir), V.spelling_index(spark, sf_dir), V.words(spark, sf_dir))


@query(f"""WITH {_VOCAB}, tries AS (SELECT DISTINCT query_id, nth AS place, term, suggestion FROM typed JOIN meant USING (term)),
changed AS (SELECT r.query_id, r.place, r.term, r.suggestion, t.nth, CASE WHEN t.nth = r.place THEN r.suggestion ELSE t.term END AS word FROM tries r JOIN typed t USING (query_id)),
whole AS (SELECT query_id, place, term, suggestion, string_agg(word, ' ' ORDER BY nth) AS fixed, count(DISTINCT word) AS k FROM changed GROUP BY ALL),
hit AS (SELECT query_id, place, chunk_id, count(DISTINCT word) AS held FROM changed JOIN postings p ON p.term = word GROUP BY query_id, place, chunk_id)
SELECT query_id, term, suggestion, fixed, count(*) AS n FROM whole JOIN hit USING (query_id, place) WHERE held = k GROUP BY ALL""")
def recovery_rerun(spark, sf_dir):
    """Each suggestion put into its query and searched for; those that find nothing aren't shown."""
    typed = _typed(spark, sf_dir)
    found = spelling.suggestions(typed, V.spelling_index(spark, sf_dir), V.words(spark, sf_dir))
    return spelling.corrected(typed, written(found, "suggestions"), V.index(spark, sf_dir))


@query()
def vec_ann_topk(spark, sf_dir):
    """The ten nearest neighbours that the built vector index finds for each query."""
    return V.vector_index(spark, sf_dir).search(V.query_vectors(spark, sf_dir), 10)


@query()
def vec_ann_recall(spark, sf_dir):
    """What the vector index finds of each query's ten exact neighbours, and the share of vectors it reads for that."""
    index, q = V.vector_index(spark, sf_dir), V.query_vectors(spark, sf_dir)
    got, exact = index.search(q, 10), retrieval.knn(V.vectors(spark, sf_dir), q, 10)
    hit = exact.join(got.select("query_id", "item_id", F.lit(1).alias("hit")), ["query_id", "item_id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 2).alias("recall")).withColumn("share_read", F.lit(round(index.share_read(10), 4)))


@query()
def text_versions(spark, sf_dir):
    """Each document against the first one with the same first line: how much of the lines they share, and the edits."""
    d = V.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = compare.compared_texts(compare.versions(d, F.substring_index("text", "\n", 1)))
    first = F.transform("hunks", lambda h: F.concat(h["tag"], F.lit("@"), h["a_start"].cast("string"), F.lit(":"), h["b_start"].cast("string")))
    return found.select("a_id", "b_id", "similarity", "a_lines", "b_lines", "same_lines", "added", "removed", "n_hunks", F.array_join(first, " ").alias("edits"))


_FRAMES = """frames AS (SELECT user_id AS video, CAST(floor(value) AS BIGINT) AS look, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


@query(f"""WITH {_FRAMES}, pairs AS (SELECT x.video AS a, y.video AS b, x.i, y.i AS j FROM frames x JOIN frames y ON x.look = y.look AND x.video < y.video),
cut AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS island FROM pairs)
SELECT a, b, i - j AS shift, min(i) AS start, max(i) AS "end", count(*) AS n FROM cut GROUP BY a, b, i - j, island HAVING count(*) >= 2""")
def video_runs(spark, sf_dir):
    """Stretches in which the frames of two videos look alike one after the other."""
    from pyspark.sql import Window

    from corvane.operators.library import frame_runs

    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return frame_runs(V.table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.floor("value").alias("look"), nth.cast("long").alias("i")))
