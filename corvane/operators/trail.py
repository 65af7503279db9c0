"""Where a page's links lead and what leads to it: out-links, a link graph both ways, and a search of it hop by hop.

An out-link is a link to another site: links inside a site (the same host or one below it) are
navigation and not citations, and links to share, log in or subscribe are noise. They come in the order of
their source's tier. The graph has all links, and a table of them turned round gives what links to an address.
A search starts from a set of addresses and goes one hop a round: the frontier's sets of seeds are sent along the
edges, what was visited before is taken out, and what is new is written as a table and is the next frontier.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import web
from corvane.tables import shuffles_freed, written

MOST_LINKS = 60
#: Rows, about, that a task makes of sets; places that a block of seeds has, and seeds of a block, about; links, about, that lead to a part's addresses.
TASK_ROWS, PLACES, SEEDS, PART_LINKS = 1_000_000, 1 << 16, 60_000, 50_000
#: Places that are listed in one batch, about, and kinds of rows that a part gets.
LISTED, LINK, SENT, THERE = 1 << 18, 0, 1, 2

#: Hosts and addresses that a page links to without citing them, and tiers in the order of their trust.
NOISE_HOST = r"(?i)(facebook|twitter|x\.com|linkedin|pinterest|reddit\.com/submit|weibo|qzone|t\.qq|api\.addthis|sharethis|instagram|youtube\.com/channel)"
NOISE_PATH = r"(?i)(/login|/signin|/register|/subscribe|/cart|/privacy|/terms|/cookie|/rss|\.xml$|/feed/?$|/tag/|/category/|/author/|#)"
TIERS = ["official", "academic", "mainstream", "community", "unknown", "low"]


def resolved(base: Column, href: Column) -> Column:
    """The address that a link in a page leads to; null for what is no page: marks in the same one, scripts, mail and telephone."""
    link = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#") | link.rlike(r"(?i)^(javascript|mailto|tel|data):"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^$", "/"), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), F.regexp_replace(link, r"^(\./)+", "")))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, nth, url, target, text): the links of pages (page_id, url, html) in order, with the words that they are on."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a>"""), F.lit(1)).alias("href"),
        F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a>"""), F.lit(2)).alias("body"),
    )
    cut = pages.select("page_id", "url", F.posexplode(found).alias("nth", "a"))
    text = F.substring(F.trim(F.regexp_replace(F.regexp_replace("a.body", r"(?s)<[^>]+>", " "), r"\s+", " ")), 1, 120)
    return cut.select("page_id", "nth", "url", resolved(F.col("url"), F.col("a.href")).alias("target"), text.alias("text")).where(F.col("target").rlike("(?i)^https?://"))


def outlinks(pages: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(page_id, target, site, text, tier, place): each page's first ``most`` links to other sites, the best tiers first."""
    bare = lambda c: F.regexp_replace(web.host(c), r"^www\.", "")
    links = page_links(pages).select("page_id", "nth", "text", "target", F.substring_index("target", "#", 1).alias("plain"), bare(F.col("target")).alias("site"), bare(F.col("url")).alias("own"))
    away = links.where((F.col("site") != "") & (F.col("site") != F.col("own")) & ~F.endswith(F.col("site"), F.concat(F.lit("."), F.col("own"))))
    cited = away.where(~F.col("site").rlike(NOISE_HOST) & ~F.col("target").rlike(NOISE_PATH))
    once = cited.groupBy("page_id", F.col("plain").alias("target"), "site").agg(F.min(F.struct("nth", "text")).alias("first"))
    listed = once.groupBy("page_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("first.nth", "target", "site", "first.text"))), 1, most).alias("links"))  # links of one page
    flat = listed.select("page_id", F.explode("links").alias("x")).select("page_id", "x.target", "x.site", "x.text", "x.nth").withColumn("tier", web.domain_tier(F.col("site")))
    order = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    ranked = flat.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), "site", "nth", "target", "text", "tier"))).alias("links"))
    return ranked.select("page_id", F.posexplode("links").alias("place", "x")).select("page_id", "x.target", "x.site", "x.text", "x.tier", (F.col("place") + 1).alias("place"))


def trail_notes(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, links, strong, note): how many sources a page cites, how many of them are official or academic, and what that says."""
    counted = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("tier").isin("official", "academic")).alias("strong"))
    joined = pages.select("page_id").join(counted, "page_id", "left").fillna(0, ["links", "strong"])
    return joined.withColumn("note", F.when(F.col("links") == 0, "no source").when(F.col("strong") == 0, "no strong source").otherwise("strong sources"))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct canonical addresses of pages and of what they link to, themselves left out."""
    return page_links(pages).select(web.canonical(F.col("url")).alias("src"), web.canonical(F.col("target")).alias("dst")).where("src <> dst").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, way): each link as out, and turned round as back."""
    return edges.select("src", "dst", F.lit("out").alias("way")).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("way")))


def trail(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, url, hop, way): every address within ``hops`` links of a seed (seed, url), at its fewest hops, by the way it was first reached ("back" before "out").

    A seed is at hop 0. With a hub what a round reaches may be the square of the hub's links, so it is kept and sent as sets: an address has the places of
    its seeds in their block, about a byte a seed. Seeds go in blocks of some SEEDS, one after the other, and addresses are dealt in parts of some PART_LINKS links that lead
    to them; a set is sent once to each part that the address leads to, and the part's task merges what comes in and leaves out what was there before.
    Each round writes its sets and frees its shuffles, so a lost executor costs one round, and disk holds the sets and one round. Rows are made of the sets where the result is read, in as many tasks as they are many.
    """
    spark = edges.sparkSession
    cores = spark.sparkContext.defaultParallelism
    links = edges.select("src", "dst", "way").dropna()
    ways = sorted(r.way for r in links.select("way").distinct().collect())
    asked = _written(seeds.select("seed", "url").distinct(), "trail_seeds")
    parts, blocks = max(cores, -(-links.count() // PART_LINKS)), max(1, -(-asked.select("seed").distinct().count() // SEEDS))
    numbered = lambda d, c, n, group, place: d.withColumn(group, F.pmod(F.xxhash64(c), F.lit(n)).cast("int")).withColumn(place, F.row_number().over(Window.partitionBy(group).orderBy(c)) - 1)
    nodes = _written(numbered(links.select(F.col("src").alias("url")).unionAll(links.select("dst")).distinct(), "url", parts, "p", "k"), "trail_addresses")
    named = _written(numbered(asked.select("seed").dropna().distinct(), "seed", blocks, "block", "place"), "trail_names")
    if (named.agg(F.max("place")).first()[0] or 0) >= PLACES:
        raise ValueError("a block of seeds is too large")
    source, target = (nodes.select(F.col("url").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in "pk")) for c in ("src", "dst"))
    way = F.array_position(F.array(*[F.lit(w) for w in ways] or [F.lit("")]), F.col("way")).cast("int")
    placed = links.join(source, "src").join(target, "dst").select(_address("src_p", "src_k").alias("at"), F.col("dst_p").alias("p"), F.col("dst_k").alias("k"), way.alias("way"))
    placed = _written(placed, "trail_links")
    leads = _written(placed.groupBy("at").agg(F.collect_set("p").alias("parts")), "trail_parts")
    starts = _written(asked.join(nodes, "url").join(named, "seed").select("block", "p", "k", F.unhex(F.lpad(F.hex("place"), 4, "0")).alias("places")), "trail_starts")
    nothing = {"kind": F.lit(0), "at": F.lit(0).cast("long"), "k": F.lit(0), "way": F.lit(0), "places": F.lit(None).cast("binary")}
    rows = lambda d, kind, **have: d.select("p", *(have.get(c, F.col(c) if c in d.columns else v).alias(c) for c, v in (nothing | {"kind": F.lit(kind)}).items()))
    out = [asked.select("seed", "url", F.lit(0).alias("hop"), F.lit("seed").alias("way"))]
    for block in range(blocks):
        before, found = starts.where(F.col("block") == block).select("p", "k", "places"), []
        visited = before
        for hop in range(1, hops + 1):
            sent = before.select(_address("p", "k").alias("at"), "places").join(leads, "at").select("at", "places", F.explode("parts").alias("p"))
            met = rows(placed, LINK).unionAll(rows(sent, SENT)).unionAll(rows(visited, THERE)).repartition(parts, "p")
            frontier = _written(met.groupBy("p").applyInArrow(_reached, "p int, k int, way int, n long, places binary"), "trail")
            found.append(frontier.withColumn("hop", F.lit(hop)))
            before = frontier.select("p", "k", "places")
            visited = visited.unionAll(before)
            if frontier.isEmpty():
                break
        held = reduce(DataFrame.unionAll, found)
        tasks = max(cores, -(-(held.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS))
        sets = held.repartition(tasks, "p", "k").hint("merge").join(nodes.repartition(tasks, "p", "k").hint("merge"), ["p", "k"]).select("url", "hop", "way", "places")
        names = F.broadcast(named.where(F.col("block") == block).select("place", "seed"))  # of one block, so bounded
        each = sets.mapInArrow(_listed, "url string, hop int, way int, places array<int>").select("url", "hop", "way", F.explode("places").alias("place")).join(names, "place")
        out.append(each.select("seed", "url", "hop", F.element_at(F.array(*[F.lit(w) for w in ways] or [F.lit("")]), F.col("way")).alias("way")))
    return reduce(DataFrame.unionAll, out)


def _written(df: DataFrame, name: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        return written(df, name)


def _address(p: str, k: str) -> Column:
    return F.col(p).cast("long") * (1 << 32) + F.col(k)


def _pack(places: np.ndarray) -> bytes:
    """Rising places as steps, all high bytes first: most are zero and cost next to nothing where they are compressed."""
    return np.diff(places, prepend=0).astype(">u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    high, low = np.frombuffer(packed, np.uint8).reshape(2, -1).astype(np.int32)
    return np.cumsum(high * 256 + low, dtype=np.int32)


def _reached(key: tuple, table: pa.Table) -> pa.Table:
    """What the links into one part's addresses bring that wasn't there: (p, k, way, n, places), with the first of all ways."""
    kind, at, k, way = (table.column(c).to_numpy() for c in ("kind", "at", "k", "way"))
    packed = table.column("places")
    sets: dict[int, list] = {}
    there: dict[int, list] = {}
    for row in np.flatnonzero(kind == SENT).tolist():
        sets.setdefault(int(at[row]), []).append(packed[row].as_py())
    for row in np.flatnonzero(kind == THERE).tolist():
        there.setdefault(int(k[row]), []).append(packed[row].as_py())
    joined = {a: np.concatenate([_unpack(x) for x in xs]) for a, xs in sets.items()}
    links = np.flatnonzero(kind == LINK)
    links = links[np.isin(at[links], np.fromiter(joined, np.int64, len(joined)))]
    links = links[np.lexsort((-way[links], k[links]))]  # the first way last, so that it stays
    first, out = np.zeros(PLACES, np.uint8), []
    for own in np.split(links, np.flatnonzero(np.diff(k[links])) + 1) if len(links) else []:
        for a, w in zip(at[own].tolist(), way[own].tolist(), strict=True):
            first[joined[a]] = w
        mine = int(k[own[0]])
        for x in there.get(mine, []):
            first[_unpack(x)] = 0
        new = np.flatnonzero(first)
        by = first[new]
        first[new] = 0
        out += [(mine, int(w), len(places := new[by == w]), _pack(places)) for w in np.unique(by)]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(np.full(len(out), key[0].as_py(), np.int32)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["p", "k", "way", "n", "places"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as lists of places, some LISTED of them at a time."""
    for batch in batches:
        packed = batch.column("places")
        sizes = np.cumsum([len(x) // 2 for x in packed.to_pylist()])
        for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes // LISTED)) + 1):
            if len(own):
                some = batch.slice(int(own[0]), len(own))
                lists = [_unpack(x.as_py()) for x in some.column("places")]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("url", "hop", "way")), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists)))], ["url", "hop", "way", "places"])
