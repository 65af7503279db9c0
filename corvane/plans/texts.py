"""Queries on texts: tokens, sentences, chunks, summaries, numbers, dates, entities, style and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import web
from corvane.functions.text import bigrams, main_script, sentences, token_estimate, tokens
from corvane.operators import passages
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.views import CHUNKS, ITEMS, TOKENS

QUERIES, ORACLE_SQL, query = registry()
_T = TOKENS.format("text")


@query(f"SELECT doc_id, len({_T}) AS n_tokens, len(list_distinct({_T})) AS n_distinct, CAST(floor(length(text) / 4) AS BIGINT) AS estimate FROM documents")
def token_stats(spark, sf_dir):
    t = tokens(F.col("text"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), token_estimate(F.col("text")).alias("estimate"))


#: RE2 has no look-behind, so the SQL puts a separator after a mark and cuts there.
_SENTENCES = r"""cut AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
sents AS (SELECT doc_id, trim(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS sentence FROM cut)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars, max(sentence) AS last FROM sents WHERE length(sentence) BETWEEN 12 AND 200 AND NOT regexp_matches(sentence, '^[#=-]') GROUP BY doc_id")
def sentence_split(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(sentences(F.col("text"), 12, 200)).alias("sentence"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"), F.max("sentence").alias("last"))


@query(r"""WITH parts AS (
  SELECT doc_id, k, generate_subscripts(range(0, length(unit), 480), 1) AS j, unnest(list_transform(range(0, length(unit), 480), lambda i: unit[i + 1:i + 480])) AS part FROM (
    SELECT doc_id, unnest(cut) AS unit, generate_subscripts(cut, 1) AS k FROM (
      SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?;])(\s)', '\1' || chr(1) || '\2', 'g'), '([。！？；…\n])', '\1' || chr(1), 'g'), chr(1)) AS cut FROM documents)) WHERE trim(unit) <> ''),
listed AS (SELECT doc_id, list({'out': []::VARCHAR[], 'now': part} ORDER BY k, j) AS l FROM parts GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(l, lambda a, x: CASE WHEN a.now <> '' AND length(a.now) + length(x.now) > 300
  THEN {'out': list_append(a.out, a.now), 'now': CASE WHEN least(45, length(a.now)) + length(x.now) <= 480 THEN a.now[-45:] || x.now ELSE x.now END} ELSE {'out': a.out, 'now': a.now || x.now} END) AS s FROM listed),
ended AS (SELECT doc_id, CASE WHEN len(s.out) > 0 AND length(s.now) < 40 AND length(s.out[-1]) + length(s.now) <= 480 THEN list_append(s.out[1:len(s.out) - 1], s.out[-1] || s.now) ELSE list_append(s.out, s.now) END AS chunks FROM folded)
SELECT doc_id, unnest(chunks) AS text, generate_subscripts(chunks, 1) - 1 AS chunk_index FROM ended""")
def chunk_pack(spark, sf_dir):
    return passages.pack_chunks(V.table(spark, sf_dir, "documents"))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text[1:4000], '[一-鿿]')) * 3 > len(regexp_extract_all(text[1:4000], '[A-Za-z]')) THEN 'zh' ELSE 'en' END AS script, lang FROM documents")
def language_detect(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", main_script(F.col("text")).alias("script"), "lang")


_TFIDF = f"""tf AS (SELECT id, term, count(*) AS c FROM (SELECT doc_id AS id, unnest({_T}) AS term FROM documents) WHERE length(term) >= 2 GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), size AS (SELECT id, sum(c) AS size FROM tf GROUP BY id),
scored AS (SELECT id, term, round(c / size::DOUBLE * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)::DOUBLE) + 1), 8) AS tfidf FROM tf JOIN df USING (term) JOIN size USING (id)),
tfidf AS (SELECT id, term, tfidf, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tfidf DESC, term) AS rank FROM scored) WHERE rank <= 12)"""


@query(f"WITH {_TFIDF} SELECT * FROM tfidf")
def tfidf_keywords(spark, sf_dir):
    return passages.tfidf(V.index(spark, sf_dir).item_terms(), V.table(spark, sf_dir, "documents"))


_RANKS = "".join(f""", r{i} AS (SELECT id, b AS term, 0.15::DOUBLE + 0.85::DOUBLE * sum(share * weight) AS weight FROM shared JOIN r{i - 1} USING (id) WHERE term = a GROUP BY ALL)""" for i in range(1, 11))


_TEXTRANK = f"""words AS (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM (SELECT doc_id AS id, list_filter({_T}, lambda x: length(x) >= 2) AS l FROM documents)),
pairs AS (SELECT x.id, x.t AS a, y.t AS b FROM words x JOIN (SELECT id, t, p, unnest([1, 2, 3, 4]) AS d FROM words) y ON x.id = y.id AND x.p = y.p - y.d WHERE x.t <> y.t),
edges AS (SELECT id, a, b, count(*)::DOUBLE AS w FROM (SELECT id, a, b FROM pairs UNION ALL SELECT id, b, a FROM pairs) GROUP BY ALL),
shared AS (SELECT id, a, b, w / sum(w) OVER (PARTITION BY id, a) AS share FROM edges), r0 AS (SELECT DISTINCT id, a AS term, 1.0::DOUBLE AS weight FROM edges){_RANKS},
textrank AS (SELECT id, term, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 6) DESC, term) AS rank FROM r10) WHERE rank <= 12)"""


@query(f"WITH {_TEXTRANK} SELECT id, term, weight FROM textrank")
def textrank_keywords(spark, sf_dir):
    return passages.keyword_ranks(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).drop("rank")


@query(f"""WITH {_TFIDF}, {_TEXTRANK}, both_ways AS (SELECT id, term, 2 * rank - 1 AS place FROM tfidf UNION ALL SELECT id, term, 2 * rank FROM textrank),
once AS (SELECT id, term, min(place) AS place FROM both_ways GROUP BY ALL) SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY place) AS rank FROM once QUALIFY rank <= 12""")
def keywords_interleaved(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return passages.interleaved(passages.tfidf(V.index(spark, sf_dir).item_terms(), d), passages.keyword_ranks(d))


@query(f"""WITH {_TFIDF}, pieces AS (
  SELECT doc_id AS id, unnest(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '([。！？；…\\n])', '\\1' || chr(1), 'g'), chr(1))) AS s,
    generate_subscripts(string_split(regexp_replace(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), '([。！？；…\\n])', '\\1' || chr(1), 'g'), chr(1)), 1) AS k FROM documents),
clean AS (SELECT id, k, trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS sentence FROM pieces),
sents AS (SELECT id, sentence, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS i FROM clean WHERE length(sentence) BETWEEN 8 AND 160 AND NOT regexp_matches(sentence, '^[#=-]')),
words AS (SELECT id, list(term) AS terms FROM tfidf GROUP BY id),
scored2 AS (SELECT s.id, i, sentence, round(2 * len(list_filter(coalesce(terms, []), lambda t: contains(lower(sentence), t))) / sqrt(length(sentence)) + 1 / (1 + 0.25::DOUBLE * i) + CASE WHEN regexp_matches(sentence, '[0-9]') THEN 0.15::DOUBLE ELSE 0 END, 6) AS score FROM sents s LEFT JOIN words USING (id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM scored2) WHERE r <= 3),
gaps AS (SELECT *, i - lag(i) OVER (PARTITION BY id ORDER BY i) AS gap FROM best)
SELECT id, string_agg((CASE WHEN gap > 1 THEN '……' ELSE '' END) || sentence[1:220], '' ORDER BY i) AS summary FROM gaps GROUP BY id""")
def extractive_summary(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    s = d.select("id", F.posexplode(sentences(F.col("text"), 8, 160)).alias("i", "sentence"))
    return passages.summary(s, passages.tfidf(V.index(spark, sf_dir).item_terms(), d).select("id", "term"))


@query(r"""WITH found AS (
  SELECT doc_id AS id, 'contact' AS kind, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)) AS name FROM documents
  UNION ALL SELECT doc_id, 'link', unnest(regexp_extract_all(text, '(https?://[^\s<>"'']+)', 1)) FROM documents
  UNION ALL SELECT doc_id, 'money', unnest(regexp_extract_all(text, '([$€£¥]\s?\d+(?:[.,]\d+)*)', 1)) FROM documents
  UNION ALL SELECT doc_id, 'version', unnest(regexp_extract_all(text, '\b(v\d+(?:\.\d+)+)', 1)) FROM documents
  UNION ALL SELECT doc_id, 'time', unnest(regexp_extract_all(text, '\b(\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2})\b', 1)) FROM documents)
SELECT id, kind, name, count(*) AS n FROM found GROUP BY ALL""")
def entity_regex(spark, sf_dir):
    return passages.entities(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(r"""WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(' ' || text, '(?i)[^\w.](\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?%', 1)) AS d FROM documents)
SELECT DISTINCT doc_id, round(CAST(replace(d, ',', '') AS DOUBLE), 6) AS value FROM found""")
def percent_values(spark, sf_dir):
    n = V.table(spark, sf_dir, "documents").select("doc_id", F.explode(passages.numbers(F.col("text"), 1 << 20)).alias("x"))
    return n.where("x.percent").select("doc_id", "x.value").distinct()


#: RE2 has no look-behind, so the SQL doubles what may stand before a number, and a match leaves one for the next. The given texts have no Han characters.
_NUMBER = r"""(?i)(?:^|[^\w.])(\d{1,3}(?:,,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:(?:\s\s)?(?:(%%)|(trillion|billion|million|thousand|k|m|bn)(?:[^A-Za-z]|$)))?"""


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(text, '([^\w.])', '\1\1', 'g') AS x FROM documents),
m AS (SELECT doc_id, regexp_extract_all(x, '{_NUMBER}', 1) AS d, regexp_extract_all(x, '{_NUMBER}', 2) AS p, regexp_extract_all(x, '{_NUMBER}', 3) AS u FROM t),
f AS (SELECT doc_id, replace(unnest(d), ',,', ',') AS d, coalesce(unnest(p), '') AS p, coalesce(lower(unnest(u)), '') AS u, generate_subscripts(d, 1) AS k FROM m),
v AS (SELECT doc_id, k, round(CAST(replace(d, ',', '') AS DOUBLE) * CASE u WHEN 'trillion' THEN 1e12 WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'bn' THEN 1e9 ELSE 1 END, 6) AS value, p <> '' AS percent FROM f WHERE NOT (p = '' AND u = '' AND regexp_matches(d, '^(19|20)[0-9]{{2}}$'))),
once AS (SELECT doc_id, value, percent, min(k) AS k FROM v GROUP BY ALL) SELECT doc_id, value, percent FROM once QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 40""")
def number_normalise(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", F.explode(passages.numbers(F.col("text"))).alias("x")).select("doc_id", "x.value", "x.percent")


@query(r"""WITH d AS (SELECT o_orderkey, o_orderdate + INTERVAL 10 YEAR AS t FROM orders),
w AS (SELECT o_orderkey, 0 AS nth, CAST(strftime(t, '%Y-%m-') || least(day(t), 28) AS DATE) AS day, 'day' AS precision FROM d
  UNION ALL SELECT o_orderkey, 1, CAST(date_trunc('month', t) AS DATE), 'month' FROM d
  UNION ALL SELECT o_orderkey, 2, CAST(strftime(t - INTERVAL 1 YEAR, '%Y-%m-') || least(day(t - INTERVAL 1 YEAR), 28) AS DATE), 'day' FROM d
  UNION ALL SELECT o_orderkey, 3, CAST(strftime(t + INTERVAL 1 YEAR, '%Y-%m-') || least(day(t + INTERVAL 1 YEAR), 28) AS DATE), 'day' FROM d)
SELECT o_orderkey, day, precision FROM w QUALIFY row_number() OVER (PARTITION BY o_orderkey, day ORDER BY nth) = 1""")
def event_dates(spark, sf_dir):
    """Order dates ten years on and their neighbours, written year first, as a month, day first and with the month's name."""
    t = F.col("o_orderdate") + F.make_ym_interval(F.lit(10))
    before, after = t - F.make_ym_interval(F.lit(1)), t + F.make_ym_interval(F.lit(1))
    text = F.concat(F.lit("on "), F.date_format(t, "yyyy-MM-dd"), F.lit(" or "), F.date_format(t, "yyyy/MM"), F.lit(" then "), F.date_format(before, "d/M/yyyy"), F.lit(" and "), F.date_format(after, "MMMM d, yyyy"), F.lit("."))
    return V.table(spark, sf_dir, "orders").select("o_orderkey", F.explode(passages.dates(text, 20)).alias("x")).select("o_orderkey", "x.day", "x.precision")


_CLICHES = "it is worth noting|in conclusion|in today''s world|plays a crucial role|it is important to note|delve into|in the realm of|a testament to|navigating the|furthermore|moreover|additionally|on the other hand|leverage|seamless|robust solution|unlock the potential|值得注意的是|综上所述|总而言之|总的来说|首先其次最后|在当今社会|随着科技的发展|众所周知|不难看出|由此可见|在一定程度上|具有重要意义|起到了重要作用|有着广泛的应用|极大地提高了|为我们提供了|不仅如此|与此同时|换句话说|需要指出的是|这不仅仅是|更是一种|在这个基础上"


@query(rf"""WITH stripped AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents),
long AS (SELECT *, lower(s) AS low, regexp_extract_all(s, '[一-鿿]') AS han FROM stripped WHERE length(s) >= 120),
cut AS (SELECT doc_id, length(regexp_replace(unnest(string_split_regex(s, '[。！？；\n]+|[.!?;]+\s')), '^\s+|\s+$', '', 'g')) AS n FROM long),
stat AS (SELECT doc_id, count(*) AS sentences, sum(n)::DOUBLE AS total, sum(n * n)::DOUBLE AS squares FROM cut WHERE n >= 4 GROUP BY doc_id),
parts AS (
  SELECT doc_id, sentences, sqrt(greatest(0.0::DOUBLE, squares / sentences - (total / sentences) * (total / sentences))) / (total / sentences) AS length_cv, s, han,
    list_concat(list_transform(range(1, greatest(len(han), 1)), lambda i: han[i] || han[i + 1]), regexp_extract_all(low, '[a-z]{{2,}}')) AS words,
    len(regexp_extract_all(low, '{_CLICHES}')) / (length(s) / 100.0::DOUBLE) AS cliche_per_100,
    CASE WHEN len(han) > 0 THEN len(list_filter(han, lambda c: contains('的了和是在有与及或而对为以等之所被把从到上中', c))) / len(han)::DOUBLE ELSE 0.0::DOUBLE END AS function_ratio
  FROM stat JOIN long USING (doc_id) WHERE sentences >= 5),
rated AS (SELECT *, CASE WHEN len(words) > 0 THEN 1 - len(list_distinct(words)) / len(words)::DOUBLE ELSE 0.0::DOUBLE END AS repeat_ratio FROM parts),
voted AS (SELECT *, (length_cv < 0.35)::BIGINT + (repeat_ratio > 0.62)::BIGINT + (function_ratio > 0.30)::BIGINT + (cliche_per_100 >= 1.2)::BIGINT AS votes FROM rated)
SELECT doc_id, sentences, round(length_cv, 4) AS length_cv, round(repeat_ratio, 4) AS repeat_ratio, round(function_ratio, 4) AS function_ratio, round(cliche_per_100, 4) AS cliche_per_100, votes,
  [0.0::DOUBLE, 0.3::DOUBLE, 0.55::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE][votes + 1] AS score FROM voted""")
def ai_style_stats(spark, sf_dir):
    return passages.style(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query("""WITH cut AS (SELECT doc_id, string_split(text, 'tion') AS l FROM documents), places AS (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM cut),
found AS (SELECT doc_id, i, regexp_extract(array_to_string(l[greatest(1, i - 10):i], 'tion')[-10:], '[A-Za-z0-9]*$') AS front FROM places),
named AS (SELECT doc_id, regexp_extract(front, '[^aeiou0-9]*$') || 'tion' AS name, min(i) AS first, count(*) AS c FROM found WHERE regexp_extract(front, '[^aeiou0-9]*$') <> '' GROUP BY 1, 2),
kept AS (SELECT * FROM named WHERE length(name) BETWEEN 3 AND 16),
owned AS (SELECT s.doc_id, s.c, arg_min(o.name, (-length(o.name), o.first)) AS owner FROM kept s JOIN kept o ON o.doc_id = s.doc_id AND contains(o.name, s.name) GROUP BY s.doc_id, s.name, s.c)
SELECT doc_id AS id, owner AS name, sum(c)::BIGINT AS n FROM owned GROUP BY doc_id, owner""")
def organisation_names(spark, sf_dir):
    """The texts have no Chinese, so words that end in "tion" stand for names, which small vowels and digits end."""
    return passages.organisations(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["tion"], "aeiou0123456789")


_FILES = [".env", "Credentials.json", "id_rsa.pub", "Web Data", ".npmrc", "server.pem", "office.ovpn", ".env.local", ".envrc", "my_passwords.txt", "api-key.yaml", "access_token", "private_key_old.bak", "密码本.docx", "notes.md", "tokenizer.py", "keyboard.txt", "pem"]


@query(r"""WITH named AS (SELECT doc_id, '/home/' || source || '/' || ['.env', 'Credentials.json', 'id_rsa.pub', 'Web Data', '.npmrc', 'server.pem', 'office.ovpn', '.env.local', '.envrc', 'my_passwords.txt', 'api-key.yaml', 'access_token', 'private_key_old.bak', '密码本.docx', 'notes.md', 'tokenizer.py', 'keyboard.txt', 'pem'][doc_id % 18 + 1] AS path FROM documents),
parts AS (SELECT *, lower(split_part(path, '/', 4)) AS name FROM named),
cut AS (SELECT *, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS ending FROM parts),
stems AS (SELECT *, name[1:length(name) - length(ending)] AS stem FROM cut)
SELECT doc_id, path, CASE
  WHEN name IN ('.env', '.npmrc', '.netrc', '.pgpass', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', 'credentials.json', 'credentials.csv', 'login data', 'cookies', 'web data')
    OR stem IN ('.env', '.npmrc', '.netrc', '.pgpass', 'id_rsa', 'id_dsa', 'id_ecdsa', 'id_ed25519', 'credentials.json', 'credentials.csv', 'login data', 'cookies', 'web data') THEN 'name'
  WHEN ending IN ('.pem', '.key', '.pfx', '.p12', '.kdbx', '.ovpn', '.ppk') THEN 'extension' WHEN starts_with(name, '.env.') THEN 'prefix'
  WHEN regexp_matches(stem, '(secret|password|passwd|api[_-]?key|access[_-]?token|private[_-]?key|credential|凭据|密钥|密码)') THEN 'keyword' END AS reason FROM stems""")
def sensitive_reason(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in _FILES])
    path = F.concat(F.lit("/home/"), "source", F.lit("/"), F.element_at(names, (F.col("doc_id") % len(_FILES) + 1).cast("int")))
    return V.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), passages.sensitive_reason(path).alias("reason"))


_URL = r"""parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'spm', 'ref', 'from', 'share', 'fbclid', 'gclid'], lower(split_part(p, '=', 1)))), '&') AS q
  FROM pages),
urls AS (SELECT *, scheme || host || path || (CASE WHEN q <> '' THEN '?' || q ELSE '' END) AS clean, regexp_replace(host || path || (CASE WHEN q <> '' THEN '?' || q ELSE '' END), '^www\.', '') AS canonical FROM parts)"""


@query(f"WITH {_URL} SELECT page_id, canonical, host FROM urls")
def url_canonical(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", web.canonical(F.col("url")).alias("canonical"), web.host(F.col("url")).alias("host"))


@query(f"WITH {_URL} SELECT page_id, sha256(clean)[1:32] AS fingerprint FROM urls")
def url_fingerprint(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", web.url_fingerprint(F.col("url")).alias("fingerprint"))


@query(r"""WITH bare AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  regexp_replace(regexp_replace(html, '(?is)<(script|style|nav|header|footer|aside)[^>]*>.*?</(script|style|nav|header|footer|aside)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)
SELECT page_id, title, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_sha256 FROM bare""")
def html_title_text(spark, sf_dir):
    p = V.table(spark, sf_dir, "pages")
    return p.select("page_id", web.html_title(F.col("html")).alias("title"), F.sha2(web.html_text(F.col("html")), 256).alias("text_sha256"))


@query(r"""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]+)"', 1)) AS link FROM pages) GROUP BY ALL""")
def page_links(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.explode(web.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


_HOSTS = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_MOVED = f"""placed AS (SELECT page_id, [{_HOSTS}, 'export.arxiv.org', 'docs.python.org', 'en.wikipedia.org', 'blog.csdn.net', 'old.reddit.com', 'cs.stanford.edu', 'www.nist.gov', 'x.ac.uk'][page_id % 9 + 1] AS site, html, url FROM pages)"""
_TIER = r"""CASE WHEN site = '' THEN 'unknown'
  WHEN list_bool_or(list_transform(['csdn.net'], lambda d: site = d OR ends_with(site, '.' || d))) THEN 'low'
  WHEN list_bool_or(list_transform(['arxiv.org', 'doi.org', 'nature.com', 'science.org', 'sciencedirect.com', 'springer.com', 'ieee.org', 'acm.org', 'pubmed.ncbi.nlm.nih.gov', 'ncbi.nlm.nih.gov', 'semanticscholar.org', 'openalex.org', 'crossref.org', 'biorxiv.org'], lambda d: site = d OR ends_with(site, '.' || d))) THEN 'academic'
  WHEN list_bool_or(list_transform(['w3.org', 'ietf.org', 'iso.org', 'python.org', 'docs.python.org', 'developer.mozilla.org', 'microsoft.com', 'learn.microsoft.com', 'docs.oracle.com', 'kernel.org', 'postgresql.org', 'sqlite.org', 'who.int'], lambda d: site = d OR ends_with(site, '.' || d))) THEN 'official'
  WHEN list_bool_or(list_transform(['wikipedia.org', 'reuters.com', 'apnews.com', 'bbc.com', 'xinhuanet.com', 'people.com.cn', 'thepaper.cn', 'caixin.com', 'github.com', 'stackoverflow.com'], lambda d: site = d OR ends_with(site, '.' || d))) THEN 'mainstream'
  WHEN list_bool_or(list_transform(['zhihu.com', 'juejin.cn', 'segmentfault.com', 'v2ex.com', 'reddit.com', 'medium.com', 'jianshu.com', 'cnblogs.com', 'bilibili.com', 'weibo.com'], lambda d: site = d OR ends_with(site, '.' || d))) THEN 'community'
  WHEN regexp_matches(site, '(^|\.)(gov|mil)(\.[a-z]{2})?$') THEN 'official' WHEN regexp_matches(site, '(^|\.)(edu|ac)(\.[a-z]{2})?$') THEN 'academic' ELSE 'unknown' END"""


def _placed(spark, sf_dir):
    """Pages with the hosts of known tiers for eight of nine, since the given hosts are all made up."""
    hosts = F.array(web.host(F.col("url")), *[F.lit(h) for h in ("export.arxiv.org", "docs.python.org", "en.wikipedia.org", "blog.csdn.net", "old.reddit.com", "cs.stanford.edu", "www.nist.gov", "x.ac.uk")])
    return V.table(spark, sf_dir, "pages").select("page_id", F.element_at(hosts, (F.col("page_id") % 9 + 1).cast("int")).alias("site"), "html", "url")


@query(f"WITH {_MOVED} SELECT page_id, site, {_TIER} AS tier FROM placed")
def domain_tier(spark, sf_dir):
    return _placed(spark, sf_dir).select("page_id", "site", web.domain_tier(F.col("site")).alias("tier"))


@query(f"""WITH {_MOVED}, linked AS (SELECT p.page_id, q.site FROM placed p JOIN placed q ON q.page_id = (p.page_id * 7 + 1) % (SELECT count(*) FROM pages) AND q.site <> p.site),
tiers AS (SELECT DISTINCT page_id, site, {_TIER} AS tier FROM linked)
SELECT tier, count(*) AS links, count(DISTINCT site) AS sites FROM tiers GROUP BY tier""")
def outlinks_by_tier(spark, sf_dir):
    p = _placed(spark, sf_dir).select("page_id", "site")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    to = p.crossJoin(F.broadcast(n)).select("page_id", F.col("site").alias("own"), ((F.col("page_id") * 7 + 1) % F.col("n")).alias("target"))
    out = to.join(p.select(F.col("page_id").alias("target"), "site"), "target").where("site <> own").select("page_id", "site").distinct()
    return out.groupBy(web.domain_tier(F.col("site")).alias("tier")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("site").alias("sites"))


@query(f"WITH hosts AS (SELECT page_id, {_HOSTS} AS site FROM pages) SELECT page_id, site, CASE WHEN len(string_split(site, '.')) < 2 THEN site ELSE array_to_string(string_split(regexp_replace(site, '^www\\.', ''), '.')[-2:], '.') END AS owner FROM hosts")
def registrable_domain(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("site"), web.registrable(web.host(F.col("url"))).alias("owner"))


@query(f"""WITH {ITEMS} SELECT item_id, '/' || source || '/' || modality AS bucket, array_to_string(regexp_extract_all(locator, '[^\\\\/._\\s-]+'), ' ') AS words FROM items""")
def path_words(spark, sf_dir):
    words = F.filter(F.split("locator", r"[\\/._\-\s]+"), lambda w: w != "")
    return V.items(spark, sf_dir).select("item_id", F.regexp_extract("locator", r"^(.*)/[^/]*$", 1).alias("bucket"), F.array_join(words, " ").alias("words"))


@query(f"""WITH {CHUNKS}, flat AS (SELECT chunk_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM chunks)
SELECT chunk_id, CASE WHEN length(s) > 1 THEN (SELECT count(DISTINCT s[i:i + 1]) FROM (SELECT unnest(range(1, length(s))) AS i)) ELSE 1 END AS n_bigrams FROM flat""")
def bigram_sets(spark, sf_dir):
    return V.chunks(spark, sf_dir).select("chunk_id", F.size(bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


@query(r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.0\.0\.0|\[?::1)|\.local$|\.internal$') AS unsafe FROM pages")
def unsafe_urls(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", web.unsafe_host(F.col("url")).alias("unsafe"))


@query(rf"""WITH {_MOVED} SELECT page_id, site, CASE WHEN list_bool_or(list_transform(['.gov', '.gov.cn', '.edu', '.edu.cn', '.ac.cn', '.ac.uk', '.mil', '.int', '.org.cn'], lambda s: ends_with(site, s))) THEN ''
  ELSE array_to_string(list_filter([CASE WHEN list_bool_or(list_transform(['.xyz', '.top', '.icu', '.cyou', '.buzz', '.click', '.link', '.shop', '.site', '.online', '.website', '.space', '.fun', '.cfd'], lambda t: ends_with(site, t))) THEN 'cheap_tld' END,
    CASE WHEN regexp_matches(site, '(?i)(\d{{3,}}\.|[a-z]{{2,}}\d{{2,4}}\.|(news|info|tech|ai|tools?|guide|tips|blog|daily|hub|zone|world)[-_]?\d{{0,4}}\.)') THEN 'farm_host' END, CASE WHEN list_bool_or(list_transform(['aggregat', 'curat', 'syndicat', 'rewrite', 'spinner', 'aizixun', 'caiji', 'zhuanzai', 'wenzhang'], lambda w: contains(site, w))) THEN 'farm_word' END,
    CASE WHEN regexp_matches(html, '(?i)(googlesyndication|adsbygoogle|pagead2|广告位|advert)') THEN 'dense_ads' END, CASE WHEN regexp_matches(html, '(?i)(下一页|第\s*\d+\s*页\s*/\s*共|next\s*page)') THEN 'paginated_bait' END,
    CASE WHEN regexp_matches(html, '(?i)(本文(转载|来源|整理)自|内容来自网络|版权归原作者所有|侵删)') THEN 'scraped_footer' END, CASE WHEN regexp_matches(html, '(小编|编辑整理|综合报道)') THEN 'no_author' END], lambda x: x IS NOT NULL), ',') END AS flags FROM placed""")
def farm_flags(spark, sf_dir):
    return _placed(spark, sf_dir).select("page_id", "site", F.array_join(web.farm_flags(F.col("site"), F.col("html")), ",").alias("flags"))
