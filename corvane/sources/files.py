"""Files of many formats as rows of text segments: a scan of a folder, a decoder for each format.

Formats without a Spark reader are decoded file by file in Arrow Python with the standard library;
a file that can't be decoded is a row with an error, and never stops the others.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.passages import sensitive_reason

#: Folders that a scan leaves out, and encodings in the order they are tried.
SKIPPED_DIRS = ["node_modules", "__pycache__", "target", "dist", "build", ".git", ".venv"]
ENCODINGS = ["utf-8", "gb18030", "big5", "shift_jis"]
ROWS_PER_SEGMENT = 200
SHEET_ROWS = 500


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, reason, content): files below a folder, hidden and junk folders left out; reason marks those that hold secrets."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.substring(F.col("path"), F.length(F.regexp_extract("path", r"^([a-z]+:/+)", 1)) + 1, 10_000)
    junk = inside.rlike("/(" + "|".join(re.escape(d) for d in SKIPPED_DIRS) + ")/")
    return files.where(~junk).select("path", "length", F.col("modificationTime").alias("modified"), sensitive_reason(F.col("path")).alias("reason"), "content")


def fingerprint(files: DataFrame) -> DataFrame:
    """Adds fingerprint: SHA-256 of the size, the first megabyte and, above two, the last one; 32 digits."""
    mb = 1 << 20
    tail = F.when(F.col("length") > 2 * mb, F.expr(f"substring(content, -{mb}, {mb})")).otherwise(F.lit(b""))
    return files.withColumn("fingerprint", F.substring(F.sha2(F.concat(F.col("length").cast("string").cast("binary"), F.expr(f"substring(content, 1, {mb})"), tail), 256), 1, 32))


def decode(raw: bytes) -> str:
    """Text of bytes: a byte order mark, then the first encoding that leaves under a hundredth of replacement marks."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    for name in ENCODINGS:
        text = raw.decode(name, "replace")
        if text.count("�") <= len(text) / 100:
            return text
    return raw.decode("latin-1")


def _csv(raw: bytes, tab: bool) -> list[tuple[str, str]]:
    rows = list(csv.reader(io.StringIO(decode(raw)), delimiter="\t" if tab else ","))
    if not rows:
        return []
    lines = [", ".join(f"{h}: {v}" for h, v in zip(rows[0], r, strict=False) if v) for r in rows[1:]]
    return [("title", " | ".join(rows[0])), *(("body", "\n".join(lines[i : i + ROWS_PER_SEGMENT])) for i in range(0, len(lines), ROWS_PER_SEGMENT))]


def _json(raw: bytes) -> list[tuple[str, str]]:
    text = decode(raw)
    try:
        return [("body", json.dumps(json.loads(text), ensure_ascii=False, indent=2))]
    except ValueError:
        return [("body", text)]


def plain_html(text: str) -> str:
    text = re.sub(r"(?is)<(script|style|nav|header|footer|aside)[^>]*>.*?</\1>", " ", text)
    return " ".join(html.unescape(re.sub(r"(?s)<[^>]+>", " ", text)).split())


def _html(raw: bytes) -> list[tuple[str, str]]:
    text = decode(raw)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    return ([("title", html.unescape(title[1]).strip())] if title else []) + [("body", plain_html(text))]


def _tag(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _texts(node: ElementTree.Element) -> str:
    return "".join(n.text or "" for n in node.iter() if _tag(n) == "t")


def _docx(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    out = []
    for node in ElementTree.fromstring(z.read("word/document.xml")).iter():
        if _tag(node) == "tbl":
            out += [("table", " | ".join(_texts(c) for c in row if _tag(c) == "tc")) for row in node if _tag(row) == "tr"]
        elif _tag(node) == "p" and _texts(node):
            style = next((v for n in node.iter() if _tag(n) == "pStyle" for v in n.attrib.values()), "")
            out.append(("title" if style.lower().startswith("heading") else "body", _texts(node)))
    return out


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    shared = [_texts(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(n) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
    out = []
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        lines = []
        for row in (n for n in ElementTree.fromstring(z.read(name)).iter() if _tag(n) == "row"):
            cells = []
            for cell in row:
                value = next((n.text or "" for n in cell if _tag(n) == "v"), _texts(cell))
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
            lines.append(" | ".join(cells))
        out += [("body", "\n".join(lines[i : i + SHEET_ROWS])) for i in range(0, len(lines), SHEET_ROWS)]
    return out


def _pptx(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", n)), key=lambda n: (number(n), "notes" in n))
    return [("notes" if "notes" in n else "body", "\n".join(filter(None, (_texts(p) for p in ElementTree.fromstring(z.read(n)).iter() if _tag(p) == "p")))) for n in slides]


def _epub(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    return [("body", plain_html(decode(z.read(n)))) for n in sorted(z.namelist()) if re.search(r"\.x?html?$", n)]


_ZIPPED = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx, "epub": _epub}


def segments_of(ext: str, raw: bytes) -> list[tuple[str, str]]:
    """(channel, text) of a file by its extension; other extensions are plain text."""
    if ext in ("csv", "tsv"):
        return _csv(raw, ext == "tsv")
    if ext == "json":
        return _json(raw)
    if ext in ("html", "htm", "xhtml"):
        return _html(raw)
    if ext in _ZIPPED:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return _ZIPPED[ext](z)
    return [("body", decode(raw))]


def segments(files: DataFrame) -> DataFrame:
    """(path, n, channel, text, error) of files (path, content)."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, n, channel, text, None) for n, (channel, text) in enumerate(segments_of(path.rpartition(".")[2].lower(), raw))]
                except Exception as e:  # a broken file is a row with its error
                    rows.append((path, 0, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "n", "channel", "text", "error"])

    return files.select("path", "content").mapInPandas(parse, "path string, n int, channel string, text string, error string")


def sections(pages: DataFrame) -> DataFrame:
    """(doc_id, page, section, text) of page texts (doc_id, page, text): a heading line opens a section that goes on over pages."""
    from pyspark.sql import Window

    heading = r"(?i)^\s*(?:\d+(?:\.\d+)*\.?\s+)?(abstract|introduction|related work|methods?|methodology|experiments?|results|discussion|conclusions?|references|acknowledge?ments?|appendix|摘要|引言|方法|实验|结果|讨论|结论|参考文献)\s*$"
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id").orderBy("page", "i").rowsBetween(Window.unboundedPreceding, 0)
    name = F.lower(F.regexp_extract("line", heading, 1))
    marked = lines.withColumn("head", F.when(name != "", name)).withColumn("section", F.last("head", ignorenulls=True).over(w)).withColumn("k", F.count("head").over(w))
    body = marked.where(F.col("head").isNull())
    return body.groupBy("doc_id", "page", "k", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text")).drop("k")
