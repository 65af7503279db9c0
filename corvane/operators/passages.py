"""Chunk packing, summaries, keywords, numbers, dates, entities and style of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import sentences, tokens
from corvane.tables import spread

TARGET, HARD, OVERLAP, TINY = 300, 480, 45, 40
#: Term counts, about, of a task that weighs them.
TASK_ROWS = 1_000_000

#: English and Chinese phrases that fill text without saying anything.
CLICHES = ["it is worth noting", "in conclusion", "in today's world", "plays a crucial role", "it is important to note", "delve into", "in the realm of", "a testament to", "navigating the", "furthermore", "moreover", "additionally", "on the other hand", "leverage", "seamless", "robust solution", "unlock the potential"]
CLICHES_ZH = ["值得注意的是", "综上所述", "总而言之", "总的来说", "首先其次最后", "在当今社会", "随着科技的发展", "众所周知", "不难看出", "由此可见", "在一定程度上", "具有重要意义", "起到了重要作用", "有着广泛的应用", "极大地提高了", "为我们提供了", "不仅如此", "与此同时", "换句话说", "需要指出的是", "这不仅仅是", "更是一种", "在这个基础上"]
#: Chinese words that hold a sentence together and say nothing of their own.
FUNCTION_WORDS_ZH = ["的", "了", "和", "是", "在", "有", "与", "及", "或", "而", "对", "为", "以", "等", "之", "所", "被", "把", "从", "到", "上", "中"]
#: What a unit after a number multiplies it by, longest names first.
UNITS = {"万亿": 1e12, "亿": 1e8, "千万": 1e7, "百万": 1e6, "万": 1e4, "trillion": 1e12, "billion": 1e9, "million": 1e6, "thousand": 1e3, "k": 1e3, "m": 1e6, "bn": 1e9}


def pack_units(units: list[str], target: int = TARGET, hard: int = HARD, overlap: int = OVERLAP, tiny: int = TINY) -> list[str]:
    """Greedy chunks of units: up to target characters, longer units cut at hard, each chunk but the first begins with the tail of the one before; tiny ends join their neighbour."""
    out: list[str] = []
    now = ""
    for unit in units:
        for part in (unit[i : i + hard] for i in range(0, len(unit), hard)):
            if now and len(now) + len(part) > target:
                out.append(now)
                now = now[-overlap:]
                now = now + part if len(now) + len(part) <= hard else part
            else:
                now += part
    if now:
        if out and len(now) < tiny and len(out[-1]) + len(now) <= hard:
            out[-1] += now
        else:
            out.append(now)
    return out


def pack_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text): sentence units packed in order, which is a fold and so runs in Arrow Python."""
    units = F.filter(F.split(F.coalesce("text", F.lit("")), r"(?<=[。！？；…\n])|(?<=[.!?;])(?=\s)"), lambda s: F.trim(s) != "")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, c) for d, u in zip(f["doc_id"], f["units"], strict=True) for i, c in enumerate(pack_units(list(u)))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "text"])

    return docs.select("doc_id", units.alias("units")).mapInPandas(pack, "doc_id long, chunk_index long, text string")


def summary(sentence_rows: DataFrame, keywords: DataFrame, take: int = 3) -> DataFrame:
    """(id, summary): the best sentences in their order, with dots where some are left out.

    Sentences are (id, i, sentence), keywords (id, term). A sentence's score is twice its keywords
    by the root of its length, plus 1 / (1 + i / 4), plus 0.15 for a digit.
    """
    hits = sentence_rows.join(keywords.groupBy("id").agg(F.collect_set("term").alias("terms")), "id", "left")
    n = F.size(F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: F.contains(F.lower("sentence"), t)))
    score = F.round(2 * n / F.sqrt(F.length("sentence")) + 1 / (1 + 0.25 * F.col("i")) + F.when(F.col("sentence").rlike("[0-9]"), 0.15).otherwise(0.0), 6)
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(score), "i"))).where(F.col("r") <= take)
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("id").orderBy("i"))
    shown = best.withColumn("shown", F.concat(F.when(gap > 1, "……").otherwise(""), F.substring("sentence", 1, 220)))
    return shown.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "shown"))), lambda x: x["shown"]), "").alias("summary"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(id, term, c) of texts (id, text)."""
    return docs.select("id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("c"))


def tfidf(counts: DataFrame, docs: DataFrame, take: int = 12, least: int = 2, only: DataFrame | None = None, df: DataFrame | None = None) -> DataFrame:
    """(id, term, tfidf, rank) of ``term_counts`` of docs: counts by length times ln((n + 1) / (df + 1)) + 1.

    With ``only`` (id) the ids in it are scored, against the frequencies in all docs; where these are given as ``df`` (term, df), counts need no others. Counts are dealt by term and then by id, in as many tasks as they are many.
    """
    tf = counts.where(F.length("term") >= least)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df is None else df
    tf = tf if only is None else tf.join(only.select("id").distinct(), "id", "left_semi")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    tasks = max(counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // TASK_ROWS) if only is None else 0)
    size = F.sum("c").over(Window.partitionBy("id"))
    met = tf.join(df.repartition(tasks, "term"), "term").crossJoin(F.broadcast(n)).repartition(tasks, "id")
    scored = met.withColumn("tfidf", F.round(F.col("c") / size * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 8))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("tfidf"), "term")).cast("long")).where(F.col("rank") <= take).select("id", "term", "tfidf", "rank")


def interleaved(first: DataFrame, second: DataFrame, take: int = 12) -> DataFrame:
    """(id, term, rank): two ranked lists (id, term, rank) of keywords taken in turn, each term once."""
    places = first.select("id", "term", (2 * F.col("rank") - 1).alias("place")).unionAll(second.select("id", "term", 2 * F.col("rank")))
    once = places.groupBy("id", "term").agg(F.min("place").alias("place"))
    return once.select("id", "term", F.row_number().over(Window.partitionBy("id").orderBy("place")).cast("long").alias("rank")).where(F.col("rank") <= take)


def _text_ranks(words: list[str], window: int, rounds: int, damping: float) -> list[tuple[str, float]]:
    """Terms of one text with their TextRank weight, heaviest first."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    terms, n = list(number), len(number)
    a, b = (np.concatenate([x[:-d] if first else x[d:] for d in range(1, window + 1) for x in [at]] or [at]) for first in (True, False))
    a, b = a[a != b], b[a != b]
    if not len(a):
        return []
    edge, w = np.unique(np.concatenate([a * n + b, b * n + a]), return_counts=True)
    src, dst = edge // n, edge % n
    share = w / np.bincount(src, w, minlength=n)[src]
    weight = np.ones(n)
    for _ in range(rounds):
        weight = 1 - damping + damping * np.bincount(dst, share * weight[src], minlength=n)
    linked = np.flatnonzero(np.bincount(dst, minlength=n))
    return sorted(((terms[i], float(np.round(weight[i], 6))) for i in linked), key=lambda x: (-x[1], x[0]))


def keyword_ranks(docs: DataFrame, take: int = 12, window: int = 4, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, term, weight, rank): TextRank over terms that stand within a window of each other in a text.

    A text's graph is no larger than the text, so it is ranked where the text is read, in Arrow batches and without a shuffle.
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms, weights, ranks = [], [], [], []
            for i, words in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist(), strict=True):
                for r, (term, weight) in enumerate(_text_ranks(words, window, rounds, damping)[:take], 1):
                    ids.append(i)
                    terms.append(term)
                    weights.append(weight)
                    ranks.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string()), pa.array(weights, pa.float64()), pa.array(ranks, pa.int64())], ["id", "term", "weight", "rank"])

    words = F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 2)
    return spread(docs.select("id", "text")).select(F.col("id").cast("long").alias("id"), words.alias("words")).mapInArrow(rank, "id long, term string, weight double, rank long")


def numbers(text: Column, limit: int = 40) -> Column:
    """Distinct (value, is_percent) of a text in order; plain years are left out, units multiply, and written-out Chinese percentages come last."""
    unit = "|".join(UNITS)
    pattern = rf"(?i)(?<![\w.])(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?)\s?(%|(?:{unit})(?![A-Za-z]))?"
    digits, units = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    by = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    both = F.transform(F.arrays_zip(digits.alias("d"), units.alias("u")), lambda x: F.struct(x["d"].alias("d"), F.lower(F.coalesce(x["u"], F.lit(""))).alias("u")))
    kept = F.filter(both, lambda x: ~((x["u"] == "") & x["d"].rlike("^(19|20)[0-9]{2}$")))
    value = lambda x: F.round(F.replace(x["d"], F.lit(","), F.lit("")).try_cast("double") * F.coalesce(by[x["u"]], F.lit(1.0)), 6)
    plain = F.transform(kept, lambda x: F.struct(value(x).alias("value"), (x["u"] == "%").alias("percent")))
    spelled = F.transform(F.regexp_extract_all(text, F.lit("百分之([零〇一二两三四五六七八九十百]{1,6})"), F.lit(1)), lambda x: F.struct(zh_number(x).alias("value"), F.lit(True).alias("percent")))
    return F.slice(F.array_distinct(F.concat(plain, F.filter(spelled, lambda x: x["value"].isNotNull()))), 1, limit)


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: How a day, a month or a year is written, in the order in which they count, with blanks around separators; a part of a longer date is none of its own. Years of both centuries count.
DATE_PATTERNS = [
    ("ymd", r"(?<!\d)((?:19|20)\d{2})\s*[-/.年]\s*(0?[1-9]|1[0-2])\s*[-/.月]\s*(0?[1-9]|[12]\d|3[01])(?!\d)"),
    ("ym", r"(?<!\d)((?:19|20)\d{2})\s*[-/年]\s*(0?[1-9]|1[0-2])(?!\s*[-/.月]\s*\d|\d)"),
    ("dmy", r"(?<![\d/-])(0?[1-9]|[12]\d|3[01])[/-](0?[1-9]|1[0-2])[/-]((?:19|20)\d{2})(?!\d)"),
    ("mdy", r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2}),?\s+((?:19|20)\d{2})\b"),
    ("y", r"(?<![\d/.,-])(?<!\d,\s)(?<!\d\s)((?:19|20)\d{2})(?![-/.年,\d]|\s+[-/.年]\s*\d)"),
]


def dates(text: Column, limit: int = 6) -> Column:
    """Distinct dates (day, precision) of the first 4000 characters, which hold when a thing happened: full ones, then months, then years.

    Days above 28 count as 28; what is no date is left out. A day that a finer pattern has given isn't given again.
    """
    head = F.substring(text, 1, 4000)

    def found(kind: str, pattern: str) -> Column:
        groups = [F.regexp_extract_all(head, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(3 if kind in ("ymd", "dmy", "mdy") else 2 if kind == "ym" else 1)]
        number = lambda x: x.try_cast("int")
        one = F.lit(1)
        parts = {
            "ymd": lambda x: (number(x["g0"]), number(x["g1"]), number(x["g2"])),
            "ym": lambda x: (number(x["g0"]), number(x["g1"]), one),
            "dmy": lambda x: (number(x["g2"]), number(x["g1"]), number(x["g0"])),
            "mdy": lambda x: (number(x["g2"]), F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(x["g0"], 1, 3))).cast("int"), number(x["g1"])),
            "y": lambda x: (number(x["g0"]), one, one),
        }[kind]

        def day(x: Column) -> Column:
            y, m, d = parts(x)
            return F.when(m.between(1, 12) & (d >= 1), F.make_date(y, m, F.least(d, F.lit(28))))

        precision = {"ym": "month", "y": "year"}.get(kind, "day")
        return F.transform(F.arrays_zip(*groups), lambda x: F.struct(day(x).alias("day"), F.lit(precision).alias("precision")))

    every = F.filter(F.concat(*[found(k, p) for k, p in DATE_PATTERNS]), lambda x: x["day"].isNotNull())
    first = F.aggregate(every, F.array().cast("array<struct<day:date,precision:string>>"), lambda kept, x: F.when(F.exists(kept, lambda k: k["day"] == x["day"]), kept).otherwise(F.array_append(kept, x)))
    return F.slice(first, 1, limit)


_ZH_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}


def zh_number(text: Column) -> Column:
    """The value of a Chinese numeral below ten thousand, null if it is none or nothing."""
    digit = F.create_map(*[F.lit(x) for kv in _ZH_DIGITS.items() for x in kv])
    each = "".join(_ZH_DIGITS)

    def unit(name: str, times: int) -> Column:
        before = F.regexp_extract(text, f"([{each}]?){name}", 1)
        return F.when(F.contains(text, F.lit(name)), F.coalesce(F.when(F.coalesce(digit[before], F.lit(0)) > 0, digit[before]), F.lit(1)) * times).otherwise(0)

    total = unit("千", 1000) + unit("百", 100) + unit("十", 10) + F.coalesce(digit[F.regexp_extract(text, f"([{each}])$", 1)], F.lit(0))
    return F.when(text.rlike(f"^[{each}十百千]+$") & (total > 0), total.cast("double"))


#: Patterns of entities that regular expressions can find.
ENTITIES = {
    "contact": r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    "link": r"(https?://[^\s<>\"']+)",
    "money": r"([$€£¥]\s?\d+(?:[.,]\d+)*)",
    "version": r"\b(v\d+(?:\.\d+)+)",
    "time": r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2})\b",
}


def entities(docs: DataFrame) -> DataFrame:
    """(id, kind, name, n) of texts (id, text)."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    found = F.concat(*[of(kind, pattern) for kind, pattern in ENTITIES.items()])
    return docs.select("id", F.explode(found).alias("e")).groupBy("id", "e.kind", "e.name").agg(F.count(F.lit(1)).alias("n"))


#: How names of organisations end, characters that are in none, and how none begins.
ORGANISATION_ENDS = ["有限公司", "股份公司", "科技公司", "公司", "集团", "大学", "学院", "中学", "小学", "医院", "银行", "研究院", "研究所", "实验室", "工作室", "事务所", "协会", "基金会", "委员会", "中心"]
ORGANISATION_STOPS = "的地得在和与及或是了也就都很不我你他她它这那有为以对从向被把等着过上下里外前后中间时候因为所以但是而且如果虽然然后并且以及由于关于请按照可能需要仅靠要让各种大型一个两个三个多个若干，。、；：！？（）【】「」《》\"'“”‘’ \t\n\r0123456789"
NO_BEGINNINGS = ("和", "与", "及", "或", "等", "为", "把", "让", "使", "有", "无", "各", "该", "其")
_NAME_REACH, _LEAST_NAME, _MOST_NAME = 10, 3, 16


def _organisations(text: str, ends: re.Pattern, stops: frozenset, name: re.Pattern) -> list[tuple[str, int]]:
    """Names in a text with how often they occur: from an ending back to a stop; names that a longer one contains count for it."""
    counts: dict[str, int] = {}
    for m in ends.finditer(text):
        at = m.start()
        while at > 0 and m.start() - at < _NAME_REACH and text[at - 1] not in stops and name.match(text[at - 1]):
            at -= 1
        found = text[at : m.end()]
        if _LEAST_NAME <= len(found) <= _MOST_NAME and at < m.start() and not found.startswith(NO_BEGINNINGS):
            counts[found] = counts.get(found, 0) + 1
    names = sorted(counts, key=len, reverse=True)  # of equal length the first in the text comes first
    joined, borders = "\n".join(names), np.cumsum([0, *(len(n) + 1 for n in names)])
    out: dict[str, int] = {}
    for short in names:
        owner = names[int(np.searchsorted(borders, joined.find(short), side="right")) - 1]
        out[owner] = out.get(owner, 0) + counts[short]
    return list(out.items())


def organisations(docs: DataFrame, ends: list[str] | None = None, stops: str = ORGANISATION_STOPS) -> DataFrame:
    """(id, name, n): organisations that texts (id, text) name, by how their names end.

    A name goes back from its ending over Han characters, letters and digits up to a character that is in no name, ten at the most, so
    that it doesn't begin in the middle of a sentence. Whole texts are read; null ones name nothing.
    """
    tail, other, name = re.compile("|".join(map(re.escape, ORGANISATION_ENDS if ends is None else ends))), frozenset(stops), re.compile("[一-龥A-Za-z0-9]")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, c in _organisations(t or "", tail, other, name)]
            ids, names, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["id", "name", "n"])

    return docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(find, "id long, name string, n long")


_SENTENCE_ENDS = re.compile(r"[。！？；\n]+|[.!?;]+\s")
_HAN, _LATIN = re.compile("[一-鿿]"), re.compile("[a-z]{2,}")
_STYLE = ["sentences", "total", "squares", "n_words", "n_distinct", "chars", "cliches", "han", "functional"]


def _style_counts(text: str) -> tuple[int, ...] | None:
    """What the style of a text is computed from; None for one that is too short."""
    s = text.strip()
    if len(s) < 120:
        return None
    lengths = [n for n in (len(x.strip()) for x in _SENTENCE_ENDS.split(s)) if n >= 4]
    if len(lengths) < 5:
        return None
    low, han = s.lower(), _HAN.findall(s)
    words = [x + y for x, y in zip(han, han[1:], strict=False)] + _LATIN.findall(low)
    cliches = sum(map(s.count, CLICHES_ZH)) + sum(map(low.count, CLICHES))
    return len(lengths), sum(lengths), sum(n * n for n in lengths), len(words), len(set(words)), len(s), cliches, len(han), sum(map(han.count, FUNCTION_WORDS_ZH))


def style(docs: DataFrame) -> DataFrame:
    """Of texts (id, text): sentence count, variation of sentence length, share of repeated words, share of function words among Han characters, clichés per 100 characters, votes and score.

    Texts under 120 characters or 5 sentences are left out. Words are pairs of Han characters in a row and runs of two
    Latin letters or more. Texts are counted once in Arrow batches; all ratios are expressions on these counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, c) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t and (c := _style_counts(t))]
            columns = zip(*(c for _, c in found), strict=True) if found else [[] for _ in _STYLE]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["id", *_STYLE])

    counted = docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(count, "id long, " + ", ".join(f"{c} long" for c in _STYLE))
    mean = F.col("total") / F.col("sentences")
    out = counted.select(
        "id", "sentences",
        (F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("sentences") - mean * mean)) / mean).alias("length_cv"),
        F.when(F.col("n_words") > 0, 1 - F.col("n_distinct") / F.col("n_words")).otherwise(0.0).alias("repeat_ratio"),
        F.when(F.col("han") > 0, F.col("functional") / F.col("han")).otherwise(0.0).alias("function_ratio"),
        (F.col("cliches") / (F.col("chars") / 100.0)).alias("cliche_per_100"),
    )
    signs = [F.col("length_cv") < 0.35, F.col("repeat_ratio") > 0.62, F.col("function_ratio") > 0.30, F.col("cliche_per_100") >= 1.2]
    score = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.3, 0.55, 0.75, 0.9)]), F.col("votes").cast("int") + 1)
    voted = out.withColumn("votes", sum((x.cast("long") for x in signs), F.lit(0).cast("long"))).withColumn("score", score)
    return voted.withColumns({c: F.round(c, 4) for c in ("length_cv", "repeat_ratio", "function_ratio", "cliche_per_100")})


#: Names, endings and beginnings of files that hold secrets, and words in their names.
SENSITIVE_NAMES = [".env", ".npmrc", ".netrc", ".pgpass", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials.json", "credentials.csv", "login data", "cookies", "web data"]
SENSITIVE_EXTENSIONS = [".pem", ".key", ".pfx", ".p12", ".kdbx", ".ovpn", ".ppk"]
SENSITIVE_PREFIXES = [".env."]
SENSITIVE_WORDS = r"(secret|password|passwd|api[_-]?key|access[_-]?token|private[_-]?key|credential|凭据|密钥|密码)"


def sensitive_reason(path: Column) -> Column:
    """Why a file shouldn't be read, or null: its name or stem, its ending, its beginning, or a word in its stem. A dot that a name begins or ends with begins no ending."""
    name = F.lower(F.regexp_extract(path, r"([^/\\]*)$", 1))
    ending = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    stem = F.when(ending == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ending)))
    begins = F.lit(False)
    for p in SENSITIVE_PREFIXES:
        begins = begins | F.startswith(name, F.lit(p))
    return (
        F.when(name.isin(SENSITIVE_NAMES) | stem.isin(SENSITIVE_NAMES), "name").when(ending.isin(SENSITIVE_EXTENSIONS), "extension")
        .when(begins, "prefix").when(stem.rlike(SENSITIVE_WORDS), "keyword")
    )
