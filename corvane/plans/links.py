"""Queries on the links of pages: where they lead, what leads to a page, and trails over several hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import web
from corvane.operators import trail as T
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.texts import _URL

QUERIES, ORACLE_SQL, query = registry()

_LINKS = rf"""{_URL}, raw AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)[^>]*>(.*?)</a>', 2)) AS body FROM pages),
links AS (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(body, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))[1:120] AS words,
    CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)//', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || href END AS target FROM raw),
aimed AS (SELECT *, lower(regexp_extract(target, '^[A-Za-z]+://([^/?#:]*)', 1)) AS site, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS own FROM links WHERE target IS NOT NULL),
named AS (SELECT a.*, u.canonical AS src, regexp_replace(site || regexp_replace(regexp_extract(target, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '^www\.', '') AS dst FROM aimed a JOIN urls u USING (page_id)),
edges AS (SELECT DISTINCT src, dst FROM named WHERE src <> dst)"""

_NOISE = "regexp_matches(site, '(?i)(facebook|twitter|x\\.com|linkedin|pinterest|reddit\\.com/submit|weibo|qzone|t\\.qq|api\\.addthis|sharethis|instagram|youtube\\.com/channel)') OR regexp_matches(target, '(?i)(/login|/signin|/register|/subscribe|/cart|/privacy|/terms|/cookie|/rss|\\.xml$|/feed/?$|/tag/|/category/|/author/|#)')"


@query(f"WITH {_LINKS} SELECT page_id, target, words, site = own AS internal, {_NOISE} AS noise, count(*) AS n FROM aimed GROUP BY ALL")
def link_targets(spark, sf_dir):
    """Every link of every page with its full address, what it is on, and why it is no citation."""
    found = T.page_links(V.table(spark, sf_dir, "pages"))
    site = web.host(F.col("target"))
    noise = site.rlike(T.NOISE_HOST) | F.col("target").rlike(T.NOISE_PATH)
    return found.groupBy("page_id", "target", F.col("text").alias("words"), (site == web.host(F.col("url"))).alias("internal"), noise.alias("noise")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINKS} SELECT dst, count(*) AS pages, min(src) AS first FROM edges GROUP BY dst")
def link_backlinks(spark, sf_dir):
    """How many pages link to each address, from the table of edges turned round."""
    back = T.both_ways(T.link_edges(V.table(spark, sf_dir, "pages"))).where("way = 'back'")
    return back.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("pages"), F.min("dst").alias("first"))


@query(f"""WITH RECURSIVE {_LINKS}, ways AS (SELECT src, dst, 'out' AS way FROM edges UNION ALL SELECT dst, src, 'back' FROM edges),
walk AS (SELECT DISTINCT canonical AS seed, canonical AS url, 0 AS hop, 'seed' AS way FROM urls UNION SELECT seed, dst, hop + 1, w.way FROM walk JOIN ways w ON src = url WHERE hop < 3),
least AS (SELECT seed, url, min(hop) AS hop FROM walk GROUP BY seed, url)
SELECT seed, url, hop, min(way) AS way FROM walk JOIN least USING (seed, url, hop) GROUP BY seed, url, hop""")
def link_trail(spark, sf_dir):
    """Everything within three links of each page, along links and against them."""
    pages = V.table(spark, sf_dir, "pages")
    edges = T.written(T.both_ways(T.link_edges(pages)), "edges")
    address = web.canonical(F.col("url"))
    return T.trail(edges, pages.select(address.alias("seed"), address.alias("url")), 3)


@query(f"""WITH {_LINKS}, cited AS (SELECT DISTINCT page_id, split_part(target, '#', 1) AS target, regexp_replace(site, '^www\\.', '') AS site FROM aimed
  WHERE regexp_replace(site, '^www\\.', '') <> regexp_replace(own, '^www\\.', '') AND NOT ends_with(site, '.' || regexp_replace(own, '^www\\.', '')) AND NOT ({_NOISE}))
SELECT page_id, least(60, count(target)) AS links, CASE WHEN count(target) = 0 THEN 'no source' ELSE 'sources' END AS note FROM pages LEFT JOIN cited USING (page_id) GROUP BY page_id""")
def trail_notes(spark, sf_dir):
    """How many sources each page cites; one that cites none can't be traced back."""
    pages = V.table(spark, sf_dir, "pages")
    return T.trail_notes(pages, T.outlinks(pages)).select("page_id", "links", F.when(F.col("links") == 0, "no source").otherwise("sources").alias("note"))
