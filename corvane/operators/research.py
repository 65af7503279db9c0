"""Around a piece of research: query variants, briefings and their export, reviews, metric tables, several libraries at once, checks of sources."""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import html_escaped
from corvane.operators.evidence import stances
from corvane.tables import spread, written

#: What is taken off the ends of a question, and engines by the language that they are good at.
QUESTION_HEAD = r"^(请问|想问一下|谁能告诉我|有没有人知道|我想知道|帮我查一下|帮我搜一下|如何|怎么|怎样|为什么|为啥|是什么|什么是|哪个|哪些|多少|能不能|可不可以)"
QUESTION_TAIL = r"(呢|吗|啊|呀|吧|的话|一下|请教|求助|谢谢)+[？?。.！!]*$"
ENGINES_ZH = ["baidu", "so360"]
ENGINES_EN = ["mojeek", "brave", "serper", "tavily", "exa", "duckduckgo"]
#: Patterns of sentences that are worth a quote, with their weights, and of those for and against something.
VALUABLE = [
    (r"(结果表明|实验表明|我们发现|研究发现|数据显示|证明了|表明)", 3.0),
    (r"(?i)(results? show|we find|we show|demonstrates?|indicates?)", 3.0),
    (r"\d+(\.\d+)?\s*[%％]", 2.5),
    (r"(相比|优于|高于|低于|提升|下降|超过)", 2.0),
    (r"(?i)(compared with|outperform|improv|reduc|achiev)", 2.0),
    (r"(提出了|本文提出|我们提出|首次)", 1.5),
    (r"(?i)(propose|present|introduce)", 1.5),
    (r"(然而|但是|局限|不足|挑战)", 1.2),
    (r"(?i)(however|limitation|challenge|drawback)", 1.2),
]
POSITIVE = r"(有效|显著|提升|优于|成功|可行|支持)"
NEGATIVE = r"(无效|不显著|未能|劣于|失败|不可行|反对|没有(发现|显著))"
#: Metrics of a paper, as (name, pattern of value and unit, unit where none is written).
METRICS = [
    ("accuracy", r"(?i)(?:准确率|accuracy|acc\.?)\s*(?:为|is|of|=|:)?\s*(\d+(?:\.\d+)?)\s*([%％]?)", "%"),
    ("f1", r"(?i)\bF1(?:[- ]score)?\s*(?:为|is|of|=|:)?\s*(\d+(?:\.\d+)?)\s*([%％]?)", ""),
    ("precision", r"(?i)(?:精确率|precision)\s*(?:为|is|of|=|:)?\s*(\d+(?:\.\d+)?)\s*([%％]?)", "%"),
    ("recall", r"(?i)(?:召回率|recall)\s*(?:为|is|of|=|:)?\s*(\d+(?:\.\d+)?)\s*([%％]?)", "%"),
    ("auc", r"(?i)\bAUC\s*(?:为|is|of|=|:)?\s*(0?\.\d+|\d+(?:\.\d+)?)\s*([%％]?)", ""),
    ("sample", r"(?i)(?:样本量|样本数|n\s*=|sample size (?:of|is)?)\s*(\d[\d,]{1,9})\s*()", "例"),
    ("parameters", r"(?i)(\d+(?:\.\d+)?)\s*([BMK])\s*(?:参数|parameters?|params)", ""),
    ("dataset", r"(?i)(?:数据集|dataset)\s*(?:为|is|:)?\s*([A-Za-z][\w\-]{2,20})\s*()", ""),
    ("time", r"(?i)(\d+(?:\.\d+)?)\s*(小时|分钟|秒|hours?|minutes?|seconds?|ms)", ""),
]


def trimmed_question(query: Column) -> Column:
    """The query without the words around a question; null if nothing goes or under two characters stay."""
    s = F.trim(query)
    out = F.regexp_replace(F.regexp_replace(s, QUESTION_HEAD, ""), QUESTION_TAIL, "")
    out = F.regexp_replace(out, r"^[ ，,。.？?！!]+|[ ，,。.？?！!]+$", "")
    return F.when((out != s) & (F.length(out) >= 2), out)


def translated(query: Column, glossary: list[tuple[str, str]]) -> Column:
    """The query with the terms of a glossary replaced, longest first; null if it holds none."""
    terms = sorted(glossary, key=lambda p: (-len(p[0]), p[0]))
    if not terms:
        return F.lit(None).cast("string")
    out = reduce(lambda q, p: F.replace(q, F.lit(p[0]), F.lit(p[1])), terms, query)
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.exists(F.array(*[F.lit(t) for t, _ in terms]), lambda t: F.contains(query, t)) & (out != query) & (out != ""), out)


def query_variants(queries: DataFrame, glossary: list[tuple[str, str]], engines: list[str]) -> DataFrame:
    """(query_id, kind, text, engines): the query, its trimmed and its translated form, each once, with the engines of its language.

    The original goes to all engines, others to those good at their language, and nowhere if there are none.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("nth"), c.alias("text")) for i, (k, c) in enumerate((("original", F.trim("query")), ("trimmed", trimmed_question(F.col("query"))), ("translated", translated(F.col("query"), glossary))))])
    rows = queries.select("query_id", F.inline(kinds)).where("text is not null AND text <> ''")
    once = rows.groupBy("query_id", F.lower("text").alias("low")).agg(F.min_by(F.struct("kind", "text"), "nth").alias("v")).select("query_id", "v.kind", "v.text")
    pick = lambda names: F.array(*[F.lit(e) for e in engines if e in names]).cast("array<string>")
    own = F.when(F.col("kind") == "original", F.array(*[F.lit(e) for e in engines])).when(F.col("text").rlike("[一-鿿]") & (F.col("kind") != "translated"), pick(ENGINES_ZH)).otherwise(pick(ENGINES_EN))
    return once.withColumn("engines", own).where(F.size("engines") > 0)


def review(papers: DataFrame, quotes: int = 5) -> DataFrame:
    """(cluster, id, quote, score, stance, rank): of each paper (cluster, id, text) its best sentence, of each cluster the best five.

    A sentence has 18 to 220 characters; its score is the sum of the weights of the patterns that it holds,
    and those without any are no quotes. Nothing is rewritten.
    """
    cut = F.split(F.coalesce("text", F.lit("")), r"(?<=[。！？；.!?;])\s*")
    tidy = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: F.length(s).between(18, 220))
    rows = papers.select("cluster", "id", F.posexplode(tidy).alias("pos", "quote"))
    scored = rows.withColumn("score", F.round(sum((F.when(F.col("quote").rlike(p), w).otherwise(0.0) for p, w in VALUABLE), F.lit(0.0)), 2)).where("score > 0")
    best = scored.groupBy("cluster", "id").agg(F.min_by(F.struct("quote", "score"), F.struct((-F.col("score")).alias("s"), "pos")).alias("b")).select("cluster", "id", "b.quote", "b.score")
    stance = F.when(F.col("quote").rlike(NEGATIVE), "negative").when(F.col("quote").rlike(POSITIVE), "positive").otherwise("neutral")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "id")).cast("long"))
    return ranked.where(F.col("rank") <= quotes).withColumn("stance", stance)


def disputed_quotes(quotes: DataFrame) -> DataFrame:
    """(cluster, place, positive, negative, positive_id, negative_id): the nth quote for something beside the nth against it, of the quotes of ``review``; nobody is said to be right."""
    nth = F.row_number().over(Window.partitionBy("cluster", "stance").orderBy("rank")).cast("long")
    told = quotes.where("stance <> 'neutral'").withColumn("place", nth)
    yes = told.where("stance = 'positive'").select("cluster", "place", F.col("quote").alias("positive"), F.col("id").alias("positive_id"))
    no = told.where("stance = 'negative'").select("cluster", "place", F.col("quote").alias("negative"), F.col("id").alias("negative_id"))
    return yes.join(no, ["cluster", "place"])


def metric_table(papers: DataFrame, metrics: list[tuple[str, str, str]] = METRICS) -> DataFrame:
    """(id, a column a metric as 'value unit' or null, filled) of papers (id, text). What isn't written stays null, and nothing is converted."""
    def cell(pattern: str, unit: str) -> Column:
        value, own = F.regexp_extract("text", pattern, 1), F.replace(F.regexp_extract("text", pattern, 2), F.lit("％"), F.lit("%"))
        return F.when(value != "", F.trim(F.concat_ws(" ", value, F.when(own != "", own).otherwise(F.lit(unit)))))

    cells = papers.select("id", *[cell(p, u).alias(n) for n, p, u in metrics])
    return cells.withColumn("filled", sum((F.col(n).isNotNull().cast("long") for n, _, _ in metrics), F.lit(0).cast("long")))


def briefing(topics: DataFrame, sentences: DataFrame, disputes: DataFrame, number_unit: str, dated: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(corpus, section, id, topic, site, text) of what was found for a query, in the words of the sources.

    Topics are (corpus, word, id), sentences (corpus, id, site, text), disputes (corpus, a, b), dated (corpus, id,
    site, published). A topic that two sites or more carry is consensus, unless one of its sentences is disputed; a topic of one
    site is an open question. Numbers are the first sentences with a number and unit, each beginning once. All these are
    quotes, and without dates there is nothing else. With dates come the timeline, which has the latest ones, and the
    matrix, which has what each of the most heard sites holds of each topic.
    """
    told = topics.join(sentences, ["corpus", "id"])
    sites = told.groupBy("corpus", "word").agg(F.count_distinct("site").alias("sites"))
    fought = disputes.select("corpus", F.explode(F.array("a", "b")).alias("id")).distinct().join(topics, ["corpus", "id"]).select("corpus", "word").distinct().withColumn("fought", F.lit(True))
    kinds = sites.join(fought, ["corpus", "word"], "left").select("corpus", "word", F.when(F.col("fought"), "dispute").when(F.col("sites") >= 2, "consensus").otherwise("open").alias("section"))
    note = lambda rows, section, i, topic, text: rows.select("corpus", section.alias("section"), i.alias("id"), topic.alias("topic"), "site", text.alias("text"))
    none, text = F.lit(None).cast("string"), F.col("text")
    by_topic = note(told.join(kinds, ["corpus", "word"]), F.col("section"), F.col("id"), F.col("word"), text)
    once = Window.partitionBy("corpus", F.substring(F.regexp_replace("text", r"\s+", ""), 1, 40)).orderBy("id")
    firsts = sentences.where(text.rlike(number_unit)).withColumn("r", F.row_number().over(once)).where("r = 1")
    few = firsts.withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy("id"))).where(F.col("r") <= most)
    out = by_topic.unionByName(note(few, F.lit("number"), F.col("id"), none, text))
    if dated is None:
        return out
    held = stances(told.select("corpus", F.col("word").alias("topic"), "id", "site", "text"))
    out = out.unionByName(note(held, F.lit("matrix"), F.lit(None).cast("long"), F.col("topic"), F.col("stance")))
    late = dated.where("published is not null").withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("published"), "id"))).where(F.col("r") <= most)
    return out.unionByName(note(late, F.lit("timeline"), F.col("id"), none, F.date_format("published", "yyyy-MM-dd")))


def _listed(lines: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*lines))), lambda x: x["line"]), "\n")


TEMPLATES = ("points", "timeline", "compare", "qa")


def research_notes(notes: DataFrame, template: str = "points") -> DataFrame:
    """(corpus, body): a briefing's notes (corpus, section, topic, id, site, url, published, text) as Markdown.

    All templates show the same quotes and only place them differently: points by section, timeline by date
    with undated ones last, compare as a table of claims by who says so and who differs, qa under a question a
    topic. Dates and matrix cells of a briefing are no quotes; they are sections of points only. A corpus is what
    one query found, so a body is bounded by its hits.
    """
    if template not in TEMPLATES:
        raise ValueError(f"no template {template}")
    if template != "points":
        notes = notes.where(~F.coalesce("section", F.lit("")).isin("matrix", "timeline"))
    text = F.when(F.col("section") == "matrix", F.concat("topic", F.lit(": "), "text")).otherwise(F.col("text"))
    quote = F.concat(F.lit("- "), text, F.lit(" ["), F.coalesce("site", F.lit("source")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))
    if template == "points":
        rows = notes.groupBy("corpus", "section").agg(_listed([F.col("id"), quote.alias("line")]).alias("line"))
        rows = rows.select("corpus", F.col("section").alias("id"), F.concat(F.lit("## "), "section", F.lit("\n\n"), "line", F.lit("\n")).alias("line"))
    elif template == "timeline":
        day = F.date_format("published", "yyyy-MM-dd")
        dated = F.when(day.isNotNull(), F.concat(F.lit("- **"), day, F.lit("** "), F.substring(quote, 3, 1 << 30))).otherwise(quote)
        rows = notes.select("corpus", F.struct(day.isNull().alias("late"), day.alias("day"), "id", "section").alias("id"), dated.alias("line"))
    elif template == "compare":
        sides = notes.where("topic is not null").groupBy("corpus", "topic").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("section") != "dispute", F.col("site")))), ", ").alias("yes"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("section") == "dispute", F.col("site")))), ", ").alias("no"))
        filled = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
        rows = sides.select("corpus", F.col("topic").alias("id"), F.concat(F.lit("| "), "topic", F.lit(" | "), filled("yes"), F.lit(" | "), filled("no"), F.lit(" |")).alias("line"))
    else:
        rows = notes.where("topic is not null").groupBy("corpus", "topic").agg(_listed([F.col("id"), quote.alias("line")]).alias("line"))
        rows = rows.select("corpus", F.col("topic").alias("id"), F.concat(F.lit("### "), "topic", F.lit("?\n\n"), "line", F.lit("\n")).alias("line"))
    head = {"points": "", "timeline": "## Timeline\n\n", "compare": "| claim | said by | disputed by |\n|---|---|---|\n", "qa": ""}[template]
    return rows.groupBy("corpus").agg(F.concat(F.lit(head), _listed([F.col("id"), F.col("line")])).alias("body"))


def research_files(bodies: DataFrame, fmt: str, title: str) -> DataFrame:
    """(corpus, extension, content) of Markdown bodies (corpus, body) as markdown, html, single-html, json or docx bytes."""
    text = F.col("body")
    if fmt == "markdown":
        return bodies.select("corpus", F.lit("md").alias("extension"), F.concat(F.lit(f"# {title}\n\n"), text).cast("binary").alias("content"))
    if fmt == "json":
        return bodies.select("corpus", F.lit("json").alias("extension"), F.to_json(F.struct(F.lit(title).alias("title"), text.alias("body"))).cast("binary").alias("content"))
    if fmt in ("html", "single-html"):
        style = "<style>body{max-width:48rem;margin:auto;font-family:sans-serif}</style>" if fmt == "single-html" else ""
        page = F.concat(F.lit(f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title>{style}<h1>{escape(title)}</h1><pre>"), html_escaped(text), F.lit("</pre>"))
        return bodies.select("corpus", F.lit("html").alias("extension"), page.cast("binary").alias("content"))
    if fmt != "docx":
        raise ValueError(f"no format {fmt}")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"corpus": f["corpus"], "extension": "docx", "content": [_docx(title, b) for b in f["body"]]})

    return bodies.select("corpus", "body").mapInPandas(pack, "corpus long, extension string, content binary")


def _docx(title: str, body: str) -> bytes:
    paragraph = lambda line: f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>' + "".join(map(paragraph, [title, *body.split("\n")])) + "</w:body></w:document>")
    return out.getvalue()


def federated(spark: SparkSession, libraries: dict[str, str], read: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of every library that can be read, with library_id, and the reasons of those that can't.

    ``read`` makes (id, text) of a library's table. A library that fails, by its path or its columns, leaves the others alone.
    """
    parts, failed = [], {}
    for name, path in libraries.items():
        try:
            parts.append(read(spark.read.parquet(path)).select(F.lit(name).alias("library_id"), F.col("id").cast("string").alias("id"), F.col("text").cast("string").alias("text")))
        except PySparkException as e:
            failed[name] = e.getCondition() or type(e).__name__
    return (reduce(DataFrame.unionByName, parts) if parts else None), failed


#: So many queries of a batch go to the tasks at once; more are more passes over the texts.
ASKED_AT_ONCE = 1000
_WORD = re.compile(r"[^\W_]+")


def _scan(asked: list[tuple[int, str, tuple]]):
    """Scores of texts for queries (query_id, query, words): how often all its words stand there, or -1000 where only the query does as a substring."""
    wanted = {w for _, _, words in asked for w in words}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for library, i, text in zip(*(batch.column(c).to_pylist() for c in ("library_id", "id", "text")), strict=True):
                held = Counter(w for w in _WORD.findall(text or "") if w in wanted)
                for query, whole, words in asked:
                    if words and all(w in held for w in words):
                        rows.append((query, library, i, sum(held[w] for w in words)))
                    elif len(whole) >= 3 and text and whole in text:
                        rows.append((query, library, i, -1000))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["query_id", "library_id", "id", "score"])

    return scan


def federated_hits(rows: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, library_id, id, score, rank) by how often a text holds the query's words; a mere substring ranks below all, by 1000.

    Libraries have no index of ours, so each text is read once for ASKED_AT_ONCE queries (query_id, query, terms), and only hits are shuffled; of
    several passes each one's first hits are written before the next.
    """
    low = spread(rows).select("library_id", "id", F.lower("text").alias("text"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.lower("query").alias("q"), F.array_distinct("terms").alias("terms"))
    passes = max(1, -(-asked.count() // ASKED_AT_ONCE))
    parts = []
    for n in range(passes):
        own = [(r.query_id, r.q or "", tuple(r.terms or ())) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n).collect()]
        hits = low.mapInArrow(_scan(own), "query_id long, library_id string, id string, score long")
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "library_id", "id")).cast("long")).where(F.col("rank") <= limit)
        parts.append(ranked if passes == 1 else written(ranked, "federated"))
    return reduce(DataFrame.unionAll, parts)


def verify_sources(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(locator, status) of records and finds (locator, fingerprint): unchanged, changed, missing or new; a record without fingerprint is unverifiable."""
    r, f = recorded.select("locator", F.col("fingerprint").alias("r"), F.lit(True).alias("known")), found.select("locator", F.col("fingerprint").alias("f"), F.lit(True).alias("there"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("there").isNull(), "missing").when(F.col("r").isNull(), "unverifiable").when(F.col("r") == F.col("f"), "unchanged").otherwise("changed")
    return r.join(f, "locator", "full").select("locator", status.alias("status"))


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(locator, fingerprint): SHA-256 of every file of a package, read by Spark; the locator is the path below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/"))
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(root) + "/", "")
    return files.select(below.alias("locator"), F.sha2("content", 256).alias("fingerprint"))


def restored(trash: DataFrame, requests: DataFrame, present: DataFrame) -> DataFrame:
    """(item_id, locator, action) of requested rows of the trash: re-ingest, or copy-out beside a locator that is taken again; what isn't in the trash is gone."""
    asked = requests.select("item_id").distinct().join(trash.select("item_id", "locator"), "item_id", "left").join(present.select("locator").distinct().withColumn("taken", F.lit(True)), "locator", "left")
    action = F.when(F.col("locator").isNull(), "gone").when(F.col("taken"), "copy-out").otherwise("re-ingest")
    return asked.select("item_id", F.when(F.col("taken"), F.concat("locator", F.lit(".restored"))).otherwise(F.col("locator")).alias("locator"), action.alias("action"))


def index_progress(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(item_id, chunks, vectors, status): keyword search comes first, vectors later; partial until all are there, broken if there are more than chunks."""
    c = chunks.groupBy("item_id").agg(F.count(F.lit(1)).alias("chunks"))
    v = vectors.groupBy("item_id").agg(F.count(F.lit(1)).alias("vectors"))
    out = c.join(v, "item_id", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))
    return out.withColumn("status", F.when(F.col("vectors") > F.col("chunks"), "broken").when(F.col("vectors") == F.col("chunks"), "ready").otherwise("partial"))
