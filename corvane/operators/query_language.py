"""The query mini-language: a short parser on the driver that yields DataFrame filters.

Directives are ``type: date: size: in: tag: section:``; ``-word`` and ``-in:`` exclude, ``"..."`` is a
phrase. An unknown directive stays text, and so does one that follows a letter, as in URLs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Directive names, other names for them, and days of relative dates.
KEYS = {"type": "type", "类型": "type", "date": "date", "日期": "date", "size": "size", "大小": "size", "in": "in", "目录": "in", "tag": "tag", "标签": "tag", "src": "src", "来源": "src", "section": "section", "章节": "section"}
RELATIVE_DAYS = {"today": 1, "今天": 1, "week": 7, "本周": 7, "month": 31, "本月": 31, "year": 366, "今年": 366}
UNITS = {"b": 1, "kb": 1024, "mb": 1024**2, "gb": 1024**3}

_DIRECTIVE = re.compile(r'(?<!\w)(-?)(\w+)[:：]("[^"]*"|\S+)')
_EXCLUDE = re.compile(r"(?:(?<=\s)|^)-(?!-)(\S+)")
_PHRASE = re.compile(r'"([^"]+)"')


@dataclass
class Query:
    text: str = ""
    phrases: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    scopes: list[str] = field(default_factory=list)
    not_scopes: list[str] = field(default_factory=list)
    since: datetime | None = None
    until: datetime | None = None  #: exclusive
    least_bytes: int | None = None
    most_bytes: int | None = None

    def merged(self, other: Query) -> Query:
        """Lists are joined; single values of ``other`` win."""
        out = Query(text=self.text)
        for name, mine in vars(self).items():
            theirs = getattr(other, name)
            if isinstance(mine, list):
                setattr(out, name, list(dict.fromkeys([*mine, *theirs])))
            elif name != "text":
                setattr(out, name, mine if theirs is None else theirs)
        return out

    def condition(self) -> Column:
        """What an item's own columns have to meet; scopes are prefixes, without regard to case."""
        tests = [F.lit(True)]
        if self.types:
            tests.append(F.lower("modality").isin(self.types))
        if self.extensions:
            tests.append(F.exists(F.array(*[F.lit(e) for e in self.extensions]), lambda e: F.lower("locator").endswith(e)))
        if self.sources:
            tests.append(F.lower("source").isin(self.sources))
        tests += [F.lower("locator").startswith(s) for s in self.scopes]
        tests += [~F.lower("locator").startswith(s) for s in self.not_scopes]
        tests += [F.col("content_time") >= F.lit(self.since)] if self.since else []
        tests += [F.col("content_time") < F.lit(self.until)] if self.until else []
        tests += [F.col("size_bytes") >= self.least_bytes] if self.least_bytes is not None else []
        tests += [F.col("size_bytes") <= self.most_bytes] if self.most_bytes is not None else []
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def filter(self, items: DataFrame, tags: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
        """Items that meet the filters; any of the tags and any of the sections will do, by semi-joins."""
        out = items.where(self.condition())
        if self.tags and tags is not None:
            out = out.join(tags.where(F.lower("tag").isin(self.tags)).select("item_id"), "item_id", "left_semi")
        if self.sections and sections is not None:
            held = F.exists(F.array(*[F.lit(s) for s in self.sections]), lambda s: F.contains(F.lower("section"), s))
            out = out.join(sections.where(held).select("item_id"), "item_id", "left_semi")
        return out


def _day(text: str) -> tuple[datetime, datetime] | None:
    """First moment and the first moment after a year, month or day."""
    m = re.fullmatch(r"(\d{4})(?:[-/.年](\d{1,2})(?:[-/.月](\d{1,2}))?)?[月日]?", text)
    if not m:
        return None
    year, month, day = int(m[1]), m[2] and int(m[2]), m[3] and int(m[3])
    try:
        start = datetime(year, month or 1, day or 1)
    except ValueError:
        return None
    if day:
        return start, start + timedelta(days=1)
    if month:
        return start, datetime(year + month // 12, month % 12 + 1, 1)
    return start, datetime(year + 1, 1, 1)


def _date(q: Query, value: str, now: datetime) -> bool:
    near = re.fullmatch(r"最近(\d+)天", value)
    days = int(near[1]) if near else RELATIVE_DAYS.get(value)
    if days:
        q.since = now - timedelta(days=days)
        return True
    if ".." in value:
        a, b = value.split("..", 1)
        first, last = _day(a), _day(b)
        if (a and not first) or (b and not last) or not (a or b):
            return False
        q.since, q.until = first[0] if first else q.since, last[1] if last else q.until
        return True
    sign, day = re.fullmatch(r"([<>]=?|)(.*)", value).groups()
    span = _day(day)
    if not span:
        return False
    if sign.startswith(">") or not sign:
        q.since = span[0]
    if sign.startswith("<") or not sign:
        q.until = span[1]
    return True


def _size(q: Query, value: str) -> bool:
    m = re.fullmatch(r"([<>]=?|)(\d+(?:\.\d+)?)(b|kb|mb|gb)?", value.lower())
    if not m:
        return False
    n = int(float(m[2]) * UNITS[m[3] or "b"])
    if m[1] == ">":
        q.least_bytes = n + 1
    elif m[1] == "<":
        q.most_bytes = n - 1
    else:
        if m[1] != "<=":
            q.least_bytes = n
        if m[1] != ">=":
            q.most_bytes = n
    return True


def parse(raw: str, now: datetime | None = None) -> Query:
    """A Query of the text's directives; what isn't one is the text that is searched."""
    q, now = Query(), now or datetime.now()

    def take(m: re.Match) -> str:
        minus, key, value = m[1], KEYS.get(m[2].lower()), m[3].strip('"')
        low = [v for v in value.lower().split(",") if v]
        if key is None or not low or (minus and key != "in"):
            return m[0]
        if key == "type":
            q.extensions += [v for v in low if v.startswith(".")]
            q.types += [v for v in low if not v.startswith(".")]
        elif key == "in":
            (q.not_scopes if minus else q.scopes).append(value.lower())
        elif key == "date" and not _date(q, value.lower(), now) or key == "size" and not _size(q, value):
            return m[0]
        else:
            {"src": q.sources, "tag": q.tags, "section": q.sections}.get(key, []).extend(low)
        return " "

    rest = _DIRECTIVE.sub(take, raw)
    q.excludes = _EXCLUDE.findall(rest)
    rest = _EXCLUDE.sub(" ", rest)
    q.phrases = _PHRASE.findall(rest)
    q.text = " ".join(rest.split())
    return q
