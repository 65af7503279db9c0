"""Text expressions: tokens, sentences, snippets, sizes and style. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
HAN = r"[一-鿿]"


def folded(text: Column) -> Column:
    """Lower-cased, with the accents of Latin letters taken off."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of folded text; runs of Han characters become their bigrams. Text that is ASCII alone is cut by a plainer pattern."""
    ascii_only = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    runs = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    bigrams = lambda run: F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, 2)))
    plain = F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.when(F.octet_length(text) == F.length(text), ascii_only).when(text.rlike(r"\p{IsHan}"), F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"\p{IsHan}"), bigrams(r)).otherwise(F.array(r))))).otherwise(plain)


def sentences(text: Column, least: int, most: int) -> Column:
    """Sentences by CJK and Latin marks, stripped, of least to most characters; headings are left out."""
    cut = F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？；…\n])|(?<=[.!?;])\s+")
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: ~s.rlike("^[#=-]") & F.length(s).between(least, most))


def token_estimate(text: Column) -> Column:
    """A Han character is a token, four other characters are one."""
    han = F.regexp_count(text, F.lit(HAN))
    return (han + F.floor((F.length(text) - han) / 4)).cast("long")


def main_script(text: Column) -> Column:
    """zh if Han characters outweigh Latin letters one to three in the first 4000 characters."""
    head = F.substring(text, 1, 4000)
    return F.when(F.regexp_count(head, F.lit(HAN)) * 3 > F.regexp_count(head, F.lit("[A-Za-z]")), "zh").otherwise("en")


def html_escaped(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def snippet(text: Column, term: Column, window: int = 160) -> Column:
    """A window around the term's first place, escaped, with the term marked and dots where text was cut."""
    at = F.greatest(F.instr(text, term) - 1 - window // 3, F.lit(0))
    body = F.substring(text, (at + 1).cast("int"), F.lit(window))
    marked = F.replace(html_escaped(body), html_escaped(term), F.concat(F.lit("<em>"), html_escaped(term), F.lit("</em>")))
    return F.concat(F.when(at > 0, "…").otherwise(""), marked, F.when(at + window < F.length(text), "…").otherwise(""))


def highlight_terms(query: Column) -> Column:
    """The different terms of a query that are marked in results, in order: its tokens, without those of words that it excludes by a leading minus, and without quotes."""
    words = F.filter(F.split(F.replace(F.coalesce(query, F.lit("")), F.lit('"'), F.lit(" ")), r"\s+"), lambda w: ~F.startswith(w, F.lit("-")))
    return F.array_distinct(F.flatten(F.transform(words, tokens)))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, blanks left out; a single character is its own pair."""
    chars = F.split(F.regexp_replace(text, r"\s+", ""), "")
    n = F.size(chars)
    return F.array_distinct(F.when(n > 1, F.zip_with(F.slice(chars, F.lit(1), n - 1), F.slice(chars, F.lit(2), n - 1), lambda a, b: F.concat(a, b))).otherwise(chars))
