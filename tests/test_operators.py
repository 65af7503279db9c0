"""Rules and properties that the given tables can't show."""

from __future__ import annotations

import io
import zipfile
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text, web
from corvane.operators import clustering, evidence, library, passages, retrieval, web_search
from corvane.operators.query_language import parse
from corvane.sources import files
from corvane.streaming import streams

NOW = datetime(2024, 6, 15)


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("annual report type:pdf", {"text": "annual report", "types": ["pdf"]}),
        ("http://a.b/c keeps", {"text": "http://a.b/c keeps"}),
        ("foo:bar", {"text": "foo:bar"}),
        ("budget -draft --flag a-b", {"text": "budget --flag a-b", "excludes": ["draft"]}),
        ('"exact words" rest', {"text": '"exact words" rest', "phrases": ["exact words"]}),
        ("类型：docx 目录:/a", {"types": ["docx"], "scopes": ["/a"], "text": ""}),
        ("date:2024-02", {"since": datetime(2024, 2, 1), "until": datetime(2024, 3, 1)}),
        ("date:2023..2024-01-31", {"since": datetime(2023, 1, 1), "until": datetime(2024, 2, 1)}),
        ("date:today", {"since": datetime(2024, 6, 14)}),
        ("date:nonsense", {"text": "date:nonsense", "since": None}),
        ("date:最近10天", {"since": datetime(2024, 6, 5)}),
        ("size:>2kb", {"least_bytes": 2049}),
        ("size:<=1.5mb", {"most_bytes": 1572864, "least_bytes": None}),
        ("in:/X -in:/x/y", {"scopes": ["/x"], "not_scopes": ["/x/y"]}),
        ("section:method tag:a,b", {"sections": ["method"], "tags": ["a", "b"]}),
    ],
)
def test_query_language(raw, wanted):
    q = parse(raw, NOW)
    assert {k: getattr(q, k) for k in wanted} == wanted


def test_merged_filters():
    q = parse("type:pdf size:>1kb", NOW).merged(parse("type:txt size:>2kb", NOW))
    assert q.types == ["pdf", "txt"] and q.least_bytes == 2049


@pytest.mark.parametrize("query, kind", [("A vs B cameras", "compare"), ("这个说法是不是真的", "factcheck"), ("config_file.yaml", "precise"), ("cats", "explore"), ("关于去年的旅行计划安排", "explore"), ("how the treaty was signed", "balanced"), ("", "balanced")])
def test_intent(spark, query, kind):
    assert one(spark, retrieval.intent(F.col("q")), q=query) == kind


def test_tokens_and_scripts(spark):
    assert one(spark, text.tokens(F.col("t")), t="Électron-builder v2 光圈景深 ß_x") == ["electron", "builder", "v2", "光圈", "圈景", "景深", "ß", "x"]
    assert one(spark, text.main_script(F.col("t")), t="光圈影响景深 ok") == "zh"
    assert one(spark, text.token_estimate(F.col("t")), t="光圈abcdefgh") == 4


def test_snippet_escapes(spark):
    assert one(spark, text.snippet(F.col("t"), F.lit("b<c")), t="a & b<c") == "a &amp; <em>b&lt;c</em>"


def test_numbers_and_dates(spark):
    got = one(spark, passages.numbers(F.col("t")), t="grew 12.5% to 1,200 units, 3 million people in 2019, 5万元")
    assert [(r.value, r.percent) for r in got] == [(12.5, True), (1200.0, False), (3e6, False), (50000.0, False)]
    got = one(spark, passages.dates(F.col("t")), t="on 2024-02-31 and 2023/7, again 2024-02-31; 2021年3月5日")
    assert [(str(r.day), r.precision) for r in got] == [("2024-02-28", "day"), ("2021-03-05", "day"), ("2023-07-01", "month")]
    got = one(spark, passages.dates(F.col("t")), t="5/11/2022, March 7, 2021, Sept. 31 2020, in 2019 and 13/13/2018")
    assert [(str(r.day), r.precision) for r in got] == [("2022-11-05", "day"), ("2021-03-07", "day"), ("2020-09-28", "day"), ("2019-01-01", "year")]
    got = one(spark, passages.dates(F.col("t")), t="2024 年 3 月 9 日; 2023 / 11 ; 2022年7月; 2021 - 02 - 03 and 1999 . 12 . 1; since 2020 年")
    assert [(str(r.day), r.precision) for r in got] == [("2024-03-09", "day"), ("2021-02-03", "day"), ("1999-12-01", "day"), ("2023-11-01", "month"), ("2022-07-01", "month"), ("2020-01-01", "year")]
    got = one(spark, passages.numbers(F.col("t")), t="百分之二十三，百分之一百零五，百分之十，百分之百，百分之零，3%")
    assert [(r.value, r.percent) for r in got] == [(3.0, True), (23.0, True), (105.0, True), (10.0, True), (100.0, True)]


def test_interests_and_memory(spark):
    assert one(spark, web.interests(F.col("t")), t="https://www.acme.com/about") == ["vendor"]
    assert one(spark, web.interests(F.col("t")), t="https://www.zhihu.com/product/1?utm_source=x") == ["ad", "ecommerce", "forum"]
    assert one(spark, web.interests(F.col("t")), t="https://a.b.example.org/x") == []
    facts = spark.createDataFrame([("t", "A fact!", 1), ("t", "a FACT", 5), ("t", "other", 9), ("u", "a fact", 2)], "topic string, text string, ts long")
    assert [(r.topic, r.seen, r.last_seen, r["rank"]) for r in web_search.recalled(facts).orderBy("topic", "rank").collect()] == [("t", 2, 5, 1), ("t", 1, 9, 2), ("u", 1, 2, 1)]
    hits = spark.createDataFrame([("s", "u1", "t"), ("s", "u1", "v"), ("s", "u2", "t")], "site string, url string, topic string")
    assert web_search.site_history(hits).collect()[0] == ("s", 2, 2, 3)
    results = spark.createDataFrame([(1, "a", "This claim is false", ""), (1, "a", "false again", ""), (1, "b", "debunked, it says in the title", "debunked"), (1, "c", "nothing", "of the kind")], "query_id long, url string, title string, snippet string")
    assert sorted(r.url for r in web_search.refuting(results).collect()) == ["a", "b"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=700), max_size=12))
def test_packed_chunks_keep_every_character(units):
    chunks = passages.pack_units(units)
    assert all(len(c) <= passages.HARD for c in chunks)
    whole = "".join(units)
    at = 0
    for c in chunks:  # each chunk goes on from the one before, with an overlap at most
        start = max(i for i in range(max(0, at - passages.OVERLAP), at + 1) if whole.startswith(c, i))
        assert start <= at
        at = start + len(c)
    assert at == len(whole)


@pytest.mark.parametrize(
    "url, wanted",
    [("https://www.Example.com/a/?utm_source=x&b=1#top", "example.com/a?b=1"), ("http://example.com/a/", "example.com/a"), ("HTTP://EXAMPLE.com:80", "example.com")],
)
def test_canonical(spark, url, wanted):
    assert one(spark, web.canonical(F.col("u")), u=url) == wanted


@pytest.mark.parametrize("site, tier", [("export.arxiv.org", "academic"), ("x.gov.uk", "official"), ("blog.csdn.net", "low"), ("nowhere.example", "unknown"), ("notarxiv.org", "unknown"), ("", "unknown")])
def test_tiers(spark, site, tier):
    assert one(spark, web.domain_tier(F.col("s")), s=site) == tier
    assert one(spark, web.domain_tier(F.col("s"), {"nowhere.example": "official"}), s="a.nowhere.example") == "official"


def test_farm_penalty(spark):
    flags = lambda *f: F.array(*[F.lit(x) for x in f]).cast("array<string>")
    values = spark.range(1).select(web.farm_penalty(flags("burst")).alias("a"), web.farm_penalty(flags("burst", "clone")).alias("b"), web.farm_penalty(flags(*web.FARM_WEIGHTS)).alias("c"), web.farm_penalty(flags()).alias("d")).first()
    assert values.a == pytest.approx(0.06) and values.b == pytest.approx(0.27) and values.c == 0.45 and values.d == 0
    assert one(spark, web.farm_flags(F.col("s"), F.lit("adsbygoogle")), s="tools-hub2024.xyz") == ["cheap_tld", "farm_host", "dense_ads"]
    assert one(spark, web.farm_flags(F.col("s"), F.lit("adsbygoogle")), s="lab.edu.cn") == []


def test_rrf_does_not_depend_on_the_order_of_routes(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, item_id long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, item_id long, rank long")
    x = retrieval.fuse({"k": a, "s": b}, {"k": 1.0, "s": 0.5})
    y = retrieval.fuse({"s": b, "k": a}, {"k": 1.0, "s": 0.5})
    key = lambda df: sorted((r.item_id, r.rrf, r.k_rank, r.s_rank) for r in df.collect())
    assert key(x) == key(y) and len(key(x)) == 3
    assert retrieval.fuse({"k": a, "s": b}, {"k": 1.0, "s": 0.0}).count() == 2


def test_knn_in_blocks_and_without_length(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(99, [0.0, 0.0, 0.0]), (100, None)]
    v = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    q = v.where("item_id < 9").withColumnRenamed("item_id", "query_id")
    whole = sorted(map(tuple, retrieval.knn(v, q, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, retrieval.knn(v, q, 4).collect())) == whole
    assert retrieval.knn(v, q.where("false"), 4).count() == 0


def test_diversity_never_raises_a_score(spark):
    rows = spark.createDataFrame([(1, i, "a" if i < 4 else "b", 1.0 - i / 10) for i in range(6)], "query_id long, item_id long, bucket string, score double")
    got = retrieval.diversify(rows, 0.5).orderBy("rank").collect()
    assert all(r.final <= r.score for r in got) and [r.item_id for r in got][:2] == [0, 1]
    assert [r.final for r in got] == sorted((r.final for r in got), reverse=True)


def test_last_writer_wins_in_any_order_and_twice(spark):
    ops = [(i, 1 + i % 3, i % 4, f"d{i % 2}", "delete" if i == 7 else "put", f"p{i}") for i in range(12)]
    schema = "op_id long, entity_id long, lamport long, device string, kind string, payload string"
    once = sorted(map(tuple, library.last_writer_wins(spark.createDataFrame(ops, schema)).collect()))
    again = sorted(map(tuple, library.last_writer_wins(spark.createDataFrame(ops[::-1] + ops[3:9], schema)).collect()))
    assert once == again


def test_verdicts(spark):
    rows = [("a", "s1", "support"), ("a", "s2", "support"), ("b", "s1", "support"), ("b", "s2", "refute"), ("c", "s1", "neutral"), ("d", "s1", "support"), ("d", "s1", "support")]
    got = {r.claim: r for r in evidence.verdicts(spark.createDataFrame(rows, "claim string, site string, stance string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"a": "supported", "b": "disputed", "c": "unverified", "d": "weak"}
    assert got["b"].controversy == 33 and got["b"].level == "medium" and got["c"].level == "unknown"


def test_clusters_keep_apart_what_shares_no_word(spark):
    rows = [(1, i, f"t{i % 10}", 1.0) for i in range(40)]
    got = clustering.clusters(spark.createDataFrame(rows, "corpus long, id long, term string, weight double")).collect()
    assert {frozenset(r.id for r in got if r.cluster == c) for c in {r.cluster for r in got}} == {frozenset(range(k, 40, 10)) for k in range(10)}


def test_breaker_opens_after_three_in_a_row(spark):
    rows = [("e", i, datetime(2024, 1, 1, 0, i), o) for i, o in enumerate(["broken", "broken", "ok", "broken", "broken", "broken", "broken"])]
    got = library.breaker(spark.createDataFrame(rows, "engine string, seq long, ts timestamp, outcome string")).collect()
    assert [r.opened_at for r in got] == [datetime(2024, 1, 1, 0, 5)]


def test_running_clusters_over_batches(spark, tmp_path):
    schema = "space long, id long, vector array<double>"
    for n, rows in enumerate([[(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0])], [(0, 3, [0.9, 0.1]), (1, 4, [1.0, 0.0])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    points = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.id: r.cluster for r in streams.settle(streams.running_clusters(points), "t", "append").collect()}
    assert got[1] == got[3] and got[1] != got[2] and got[4] == 0


def test_running_clusters_are_a_fold_in_order(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    schema = "space long, id long, vector array<double>"
    vectors = rng.standard_normal((120, 6))
    for n in range(3):
        spark.createDataFrame([(i % 2, i, vectors[i].tolist()) for i in range(40 * n, 40 * n + 40)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    points = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.id: r.cluster for r in streams.settle(streams.running_clusters(points, 0.6), "folded", "append").collect()}
    wanted, sums = {}, {0: [], 1: []}
    for i, v in enumerate(vectors):
        v, own = v / np.linalg.norm(v), sums[i % 2]
        near = [v @ s / np.linalg.norm(s) for s in own]
        if near and max(near) >= 0.6:
            wanted[i] = int(np.argmax(near))
            own[wanted[i]] = own[wanted[i]] + v
        else:
            wanted[i] = len(own)
            own.append(v)
    assert got == wanted and max(wanted.values()) > 10


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_X", ".x"), body)
    return out.getvalue()


def test_files(spark, tmp_path):
    w = 'xmlns:w="w"'
    made = {
        "a.txt": "plain é".encode(), "b.txt": "中文内容".encode("gb18030"), "c.csv": b"name,age\nx,1\ny,\n", "d.json": b'{"a":[1,2]}', "e.json": b"{broken",
        "f.html": b"<title>T &amp; U</title><nav>menu</nav><p>Hello <b>you</b></p>", "g.docx": zipped(word__document_Xml=f'<w:document {w}><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:document>'),
        "h.xlsx": zipped(xl__sharedStrings_Xml="<sst><si><t>s0</t></si></sst>", xl__worksheets__sheet1_Xml='<worksheet><row><c t="s"><v>0</v></c><c><v>7</v></c></row></worksheet>'),
        "i.pptx": zipped(ppt__slides__slide1_Xml="<s><p><t>Slide</t></p></s>"), "j.epub": zipped(ch1_Xhtml="<p>Chapter</p>"), "k.docx": b"no zip", ".env": b"SECRET=1",
    }
    for name, body in made.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.txt").write_text("junk")
    found = files.fingerprint(files.scan(spark, str(tmp_path)))
    rows = {r.path.rpartition("/")[2]: r for r in found.collect()}
    assert "x.txt" not in rows and all(len(r.fingerprint) == 32 for r in rows.values())
    got = {}
    for r in files.segments(found).orderBy("n").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.channel, r.text) if r.error is None else ("error", r.error[:10]))
    assert got["a.txt"] == [("body", "plain é")] and got["b.txt"] == [("body", "中文内容")]
    assert got["c.csv"] == [("title", "name | age"), ("body", "name: x, age: 1\nname: y")]
    assert got["d.json"] == [("body", '{\n  "a": [\n    1,\n    2\n  ]\n}')] and got["e.json"] == [("body", "{broken")]
    assert got["f.html"] == [("title", "T & U"), ("body", "T & U Hello you")]
    assert got["g.docx"] == [("title", "Head"), ("body", "Body")] and got["h.xlsx"] == [("body", "s0 | 7")]
    assert got["i.pptx"] == [("body", "Slide")] and got["j.epub"] == [("body", "Chapter")] and got["k.docx"][0][0] == "error"


def test_sections_go_on_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "Title\n1. Introduction\nfirst"), (1, 2, "second\nMethods\nthird")], "doc_id long, page int, text string")
    got = sorted((r.page, r.section, r.text) for r in files.sections(pages).where("section is not null").collect())
    assert got == [(1, "introduction", "first"), (2, "introduction", "second"), (2, "methods", "third")]
