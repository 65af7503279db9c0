"""URL, host and HTML expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track where a visit came from.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "spm", "ref", "from", "share", "fbclid", "gclid"]

#: Tiers of sources and their weights, domains and suffix patterns by tier.
TIER_WEIGHTS = {"official": 1.00, "academic": 0.95, "mainstream": 0.75, "community": 0.55, "unknown": 0.45, "low": 0.12}
DOMAIN_TIERS = {
    "academic": ["arxiv.org", "doi.org", "nature.com", "science.org", "sciencedirect.com", "springer.com", "ieee.org", "acm.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "semanticscholar.org", "openalex.org", "crossref.org", "biorxiv.org"],
    "official": ["w3.org", "ietf.org", "iso.org", "python.org", "docs.python.org", "developer.mozilla.org", "microsoft.com", "learn.microsoft.com", "docs.oracle.com", "kernel.org", "postgresql.org", "sqlite.org", "who.int"],
    "mainstream": ["wikipedia.org", "reuters.com", "apnews.com", "bbc.com", "xinhuanet.com", "people.com.cn", "thepaper.cn", "caixin.com", "github.com", "stackoverflow.com"],
    "community": ["zhihu.com", "juejin.cn", "segmentfault.com", "v2ex.com", "reddit.com", "medium.com", "jianshu.com", "cnblogs.com", "bilibili.com", "weibo.com"],
    "low": ["csdn.net"],
}
SUFFIX_TIERS = [(r"(^|\.)(gov|mil)(\.[a-z]{2})?$", "official"), (r"(^|\.)(edu|ac)(\.[a-z]{2})?$", "academic")]

#: Signs of content farms in domain names and pages, and their weights in the penalty.
CHEAP_TLDS = [".xyz", ".top", ".icu", ".cyou", ".buzz", ".click", ".link", ".shop", ".site", ".online", ".website", ".space", ".fun", ".cfd"]
FARM_HOST = r"(\d{3,}\.|[a-z]{2,}\d{2,4}\.|(news|info|tech|ai|tools?|guide|tips|blog|daily|hub|zone|world)[-_]?\d{0,4}\.)"
FARM_WORDS = ["aggregat", "curat", "syndicat", "rewrite", "spinner", "aizixun", "caiji", "zhuanzai", "wenzhang"]
TRUSTED_SUFFIXES = [".gov", ".gov.cn", ".edu", ".edu.cn", ".ac.cn", ".ac.uk", ".mil", ".int", ".org.cn"]
LAYOUT = {
    "dense_ads": r"(?i)(googlesyndication|adsbygoogle|pagead2|广告位|advert)",
    "paginated_bait": r"(?i)(下一页|第\s*\d+\s*页\s*/\s*共|next\s*page)",
    "scraped_footer": r"(?i)(本文(转载|来源|整理)自|内容来自网络|版权归原作者所有|侵删)",
    "no_author": r"(小编|编辑整理|综合报道)",
    "keyword_stuffing": r"([一-鿿]{2,6})(、\1){3,}",
}
#: What a source has to do with what it writes on.
INTERESTS = {
    "vendor": r"(?i)^(www\.)?[a-z0-9-]+\.(com|cn|io|ai)$",
    "ad": r"(?i)(/ad[s]?/|utm_(source|medium|campaign)=|/promo|/sponsor|/affiliate)",
    "ecommerce": r"(?i)(taobao|tmall|jd\.com|amazon|ebay|pinduoduo|item\.|/product/|/dp/)",
    "pr": r"(?i)(prnewswire|businesswire|globenewswire|美通社|新闻稿)",
    "forum": r"(?i)(zhihu|tieba|reddit|quora|stackexchange|v2ex|douban)",
    "selfmedia": r"(?i)(mp\.weixin\.qq\.com|toutiao|baijiahao|sohu\.com/a/|163\.com/dy/)",
}
FARM_WEIGHTS = {"cheap_tld": 0.05, "farm_host": 0.10, "farm_word": 0.12, "dense_ads": 0.06, "paginated_bait": 0.08, "scraped_footer": 0.12, "no_author": 0.05, "keyword_stuffing": 0.08, "burst": 0.12, "clone": 0.15}
MAX_PENALTY = 0.45


def host(url: Column) -> Column:
    """Lower-cased host without port; text without a scheme is taken as a host."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_extract(bare, r"^([^/?#:]*)", 1)


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^/?#]*([^?#]*)", 1), "/+$", "")


def _query(url: Column) -> Column:
    kept = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")


def without_tracking(url: Column) -> Column:
    """Scheme, host, path and the parameters that aren't tracking; no fragment, no slash at the end."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1))
    return F.concat(scheme, host(url), _path(url), _query(url))


def canonical(url: Column) -> Column:
    """As ``without_tracking``, without scheme and ``www.``."""
    return F.regexp_replace(F.concat(host(url), _path(url), _query(url)), r"^www\.", "")


def url_fingerprint(url: Column) -> Column:
    return F.substring(F.sha2(without_tracking(url), 256), 1, 32)


def registrable(site: Column) -> Column:
    """The last two labels of a host, three where the last two are a public suffix of a country."""
    labels = F.split(F.regexp_replace(site, r"^www\.", ""), r"\.")
    n = F.size(labels)
    three = (n >= 3) & F.concat_ws(".", F.slice(labels, -2, 2)).rlike(r"^(com|co|org|net|gov|edu|ac)\.[a-z]{2}$")
    return F.when(n < 2, site).when(three, F.array_join(F.slice(labels, -3, 3), ".")).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def domain_tier(site: Column, overrides: dict[str, str] | None = None) -> Column:
    """Tier of a host: the user's overrides, the table by any parent domain, then suffixes, else unknown."""
    def under(domains: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (site == d) | site.endswith(F.concat(F.lit("."), d)))

    out = F.when(F.coalesce(site, F.lit("")) == "", "unknown")
    for d, tier in (overrides or {}).items():
        out = out.when(under([d]), tier)
    for tier in ("low", "academic", "official", "mainstream", "community"):
        out = out.when(under(DOMAIN_TIERS[tier]), tier)
    for pattern, tier in SUFFIX_TIERS:
        out = out.when(site.rlike(pattern), tier)
    return out.otherwise("unknown")


def tier_weight(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv]), tier)


def trusted(site: Column) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in TRUSTED_SUFFIXES]), lambda s: site.endswith(s))


def farm_flags(site: Column, html: Column) -> Column:
    """Signs of a content farm in a host and a page; trusted hosts have none."""
    flags = F.array_compact(
        F.array(
            F.when(F.exists(F.array(*[F.lit(t) for t in CHEAP_TLDS]), lambda t: site.endswith(t)), "cheap_tld"),
            F.when(site.rlike("(?i)" + FARM_HOST), "farm_host"),
            F.when(F.exists(F.array(*[F.lit(w) for w in FARM_WORDS]), lambda w: F.contains(site, w)), "farm_word"),
            *[F.when(html.rlike(p), name) for name, p in LAYOUT.items()],
        )
    )
    return F.when(trusted(site), F.array().cast("array<string>")).otherwise(flags)


def interests(url: Column) -> Column:
    """What a page's address says of its interest; a vendor's site only where it says nothing else."""
    other = F.array_compact(F.array(*[F.when(url.rlike(p), name) for name, p in INTERESTS.items() if name != "vendor"]))
    return F.when((F.size(other) == 0) & host(url).rlike(INTERESTS["vendor"]), F.array(F.lit("vendor"))).otherwise(other)


def farm_penalty(flags: Column) -> Column:
    """Sum of the flags' weights up to the cap; a burst that is no clone counts half."""
    weights = F.create_map(*[F.lit(x) for kv in FARM_WEIGHTS.items() for x in kv])
    total = F.least(F.lit(MAX_PENALTY), F.aggregate(flags, F.lit(0.0), lambda acc, f: acc + F.coalesce(weights[f], F.lit(0.0))))
    alone = F.array_contains(flags, "burst") & ~F.array_contains(flags, "clone")
    return F.greatest(F.lit(0.0), F.when(alone, total - FARM_WEIGHTS["burst"] / 2).otherwise(total))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Text without scripts, styles, navigation and tags, the common entities undone, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|aside)[^>]*>.*?</(script|style|nav|header|footer|aside)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]+)"'), F.lit(1))


def urls_in(text: Column, limit: int = 50) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"'）)】]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?。，；：！？]+$", ""))), 1, limit)


def unsafe_host(url: Column) -> Column:
    """Loopback, private and link-local addresses and names that shouldn't be fetched."""
    return host(url).rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.|0\.0\.0\.0|\[?::1)|\.local$|\.internal$")


#: Signs of content farms in titles and snippets, and of texts written by rote in Chinese and in English.
FARM_TITLE = r"(震惊|速看|删前|必看|太可怕|不看后悔|涨知识|收藏了|万万没想到|最全总结|一文看懂|全网最|建议收藏|干货满满)"
REPOST_MARK = r"(本文(转载|转自|来源)|声明[:：]?\s*本文|版权归原作者所有|侵删|如有侵权.{0,12}联系|文章来源[:：]|原文链接[:：])"
ROTE_ZH = r"(在当今[^，。]{0,8}(社会|时代|背景下)|随着[^，。]{0,10}的(不断)?发展|综上所述|总而言之|首先.{0,30}其次.{0,30}最后|值得注意的是|需要注意的是|在这个[^，。]{0,6}的时代)"
ROTE_EN = r"(?i)(in today'?s (fast-paced|digital|modern) world|it'?s important to note that|in conclusion,|delve into|it is worth noting|plays a (crucial|vital|key) role|in the ever-evolving|unlock the (power|potential)|game-?changer)"


def title_flags(title: Column, snippet: Column) -> Column:
    """Signs of a content farm in a title and a snippet; null is empty."""
    t, s = F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(r"([一-鿿]{2,6}|[a-zA-Z]{3,})"), F.lit(1))
    stuffed = F.exists(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda x: x == w)) >= 3)
    head = F.substring(t, 1, 20)
    return F.array_compact(F.array(
        F.when(t.rlike(FARM_TITLE), "clickbait"), F.when(s.rlike(REPOST_MARK), "repost"), F.when(stuffed, "stuffed"),
        F.when((s != "") & (head != "") & (F.length(s) < 80) & F.contains(s, head), "echo"), F.when(F.regexp_count(t, F.lit(r"[_|｜\-–—]")) >= 4, "joined"),
    ))


def rote_flags(title: Column, snippet: Column, other_hosts: Column) -> Column:
    """Signs of a text made by machine: rote phrases, without anything concrete or many of them, or the same text on three other hosts."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("。"), F.coalesce(snippet, F.lit("")))
    told = F.regexp_count(text, F.lit(ROTE_ZH)) + F.regexp_count(text, F.lit(ROTE_EN))
    concrete = F.regexp_count(text, F.lit(r"\d{2,}|[A-Z][a-zA-Z]{2,}|\d+%|v\d+\.\d+"))
    flags = F.array_compact(F.array(F.when((told >= 2) & (concrete == 0), "rote_only").when(told >= 3, "rote"), F.when(other_hosts >= 3, "same_text")))
    return F.when(F.length(text) < 40, F.array().cast("array<string>")).otherwise(flags)


def age_days(published: Column, as_of: Column) -> Column:
    """Whole days from a written date to ``as_of``, at least 0; of a year and month, from the first. Null where it can't be read, never today."""
    s = F.trim(published)
    day = F.coalesce(
        F.try_to_timestamp(F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:?\d{2}))$", 1)),
        F.try_to_timestamp(F.regexp_replace(F.regexp_extract(s, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})$", 1), "/", "-")),
        F.try_to_timestamp(F.concat(F.regexp_extract(s, r"^(\d{4})[-/年]\d{1,2}", 1), F.lit("-"), F.regexp_extract(s, r"^\d{4}[-/年](\d{1,2})", 1), F.lit("-1"))),
    )
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(day)) / 86400))).cast("long")


def plain_abstract(text: Column) -> Column:
    """Text without tags, the common entities undone, blanks collapsed; null is empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
