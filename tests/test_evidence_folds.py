"""Folds without SQL, and what sources hold of topics, on small fixtures worked out by hand or by plain Python."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from corvane.operators import evidence, passages, research


def test_topics_are_taken_greedily_each_sentence_once(spark):
    rows = [
        (1, 1, "a", ["storm", "coast"]), (1, 2, "b", ["storm", "wind"]), (1, 3, "c", ["storm"]), (1, 4, "a", ["storm", "alone"]), (1, 5, "a", ["storm"]),  # a third sentence of site a is left out
        (1, 6, "b", ["wind"]), (1, 7, "c", ["wind"]), (1, 8, "d", ["single"]), (2, 9, "a", ["x"]),
    ]
    got = [tuple(r) for r in evidence.topics(spark.createDataFrame(rows, "corpus long, id long, site string, terms array<string>")).orderBy("corpus", "topic", "id").collect()]
    assert got == [(1, 0, "storm", 1), (1, 0, "storm", 2), (1, 0, "storm", 3), (1, 0, "storm", 4), (1, 1, "wind", 6), (1, 1, "wind", 7)]


def test_passages_that_say_the_same_are_one(spark):
    rows = [(1, 1, 0.9, "the cat sat on the mat"), (1, 2, 0.8, "the cat sat on the mat!"), (1, 3, 0.7, "a dog ran off"), (1, 4, 0.95, "zebra"), (2, 5, 0.1, "the cat sat on the mat")]
    rows += [(3, 10 + i, 1 - i / 100, f"{chr(97 + i) * 6} {i * 7919}") for i in range(9)]
    got = {(r.query_id, r.id): r["rank"] for r in evidence.distinct_passages(spark.createDataFrame(rows, "query_id long, id long, score double, text string")).collect()}
    bigrams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    wanted = {}
    for q in {r[0] for r in rows}:
        kept = []
        for _, i, _, text in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1])):
            own = bigrams(re.sub(r"\s+", "", text))
            if len(kept) < 6 and all(len(own & k) / min(len(own), len(k)) < 0.82 for k in kept):
                kept.append(own)
                wanted[q, i] = len(kept)
    assert got == wanted and (1, 2) not in got and len([k for k in got if k[0] == 3]) == 6


def test_negating_words_end_at_what_is_no_ascii_letter(spark):
    """As many as the SQL's pattern finds, also beside accented letters and Han characters, in whatever version of Java."""
    import duckdb

    texts = ["noñboga", "sí, no ciónt", "éno", "他not好", "note know nor", "No_ no1 NOT", "don't can'té n'tx", "never-no", "不是 never", "", "nono no no"]
    counted = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.regexp_count("text", F.lit(evidence.NEGATION)), F.col("text").rlike(evidence.NEGATION)).orderBy("id").collect()
    wanted = [len(duckdb.execute(r"SELECT regexp_extract_all(?, '(?i)(不|没|无|非|未|\bnot\b|\bno\b|\bnever\b|n''t\b)')", [t]).fetchone()[0]) for t in texts]
    assert [tuple(r)[1:] for r in counted] == [(n, n > 0) for n in wanted] and wanted[0] == 1
    told = [(1, "noñboga", 1, "s1", "noñboga"), (1, "noñboga", 2, "s2", "other")]
    found = evidence.stances(spark.createDataFrame(told, "corpus long, topic string, id long, site string, text string"))
    assert {(r.site, r.stance) for r in found.collect()} == {("s1", "mixed"), ("s2", "positive")}


def sentences():
    return [
        (1, 1, "a", "The river rose by 40% in May."), (1, 2, "b", "The river did not rise, they never saw it."), (1, 3, "c", "A bridge was built."), (1, 4, "a", "The river rose by 40% in May."),
        (1, 5, "d", "The bridge is new."), (1, 6, "e", "Nobody knows the tunnel."), (2, 7, "a", "Other 3 km of road"),
    ]


def test_a_briefing_has_all_its_sections(spark):
    topics = spark.createDataFrame([(1, "river", 1), (1, "river", 2), (1, "bridge", 3), (1, "bridge", 5), (1, "tunnel", 6)], "corpus long, word string, id long")
    told = spark.createDataFrame(sentences(), "corpus long, id long, site string, text string")
    disputes = spark.createDataFrame([(1, 2, 1)], "corpus long, a long, b long")
    dated = spark.createDataFrame([(1, i, s, datetime(2024, 1, 10 - i) if i != 3 else None) for _, i, s, _ in sentences()], "corpus long, id long, site string, published timestamp")
    got = {(r.corpus, r.section, r.id, r.topic, r.site, r.text) for r in research.briefing(topics, told, disputes, r"\d+\s*(?:%|km)", dated, 3).collect()}
    text = {i: t for _, i, _, t in sentences()}
    assert {g for g in got if g[1] not in ("matrix", "timeline")} == {
        (1, "dispute", 1, "river", "a", text[1]), (1, "dispute", 2, "river", "b", text[2]), (1, "consensus", 3, "bridge", "c", text[3]), (1, "consensus", 5, "bridge", "d", text[5]),
        (1, "open", 6, "tunnel", "e", text[6]), (1, "number", 1, None, "a", text[1]), (2, "number", 7, None, "a", text[7]),
    }
    assert {g[2:] for g in got if g[1] == "timeline"} == {(1, None, "a", "2024-01-09"), (2, None, "b", "2024-01-08"), (4, None, "a", "2024-01-06")}
    matrix = {(g[3], g[4]): g[5] for g in got if g[1] == "matrix"}
    assert matrix["river", "a"] == "positive" and matrix["river", "b"] == "negative" and matrix["bridge", "a"] == "silent" and len(matrix) == 3 * 5


def test_sites_hold_something_of_topics(spark):
    told = [(1, "t", 1, "a", "It is not so, no."), (1, "t", 2, "b", "It is so."), (1, "u", 3, "a", "never"), (1, "u", 4, "c", "yes"), (1, "u", 5, "c", "yes")] + [(2, "t", i, f"s{i:02}", "yes") for i in range(12)]
    got = {(r.corpus, r.topic, r.site): (r.place, r.stance, r.disagree) for r in evidence.stances(spark.createDataFrame(told, "corpus long, topic string, id long, site string, text string")).collect()}
    assert got[1, "t", "a"] == (1, "negative", True) and got[1, "t", "b"] == (3, "positive", True) and got[1, "t", "c"] == (2, "silent", True)
    assert got[1, "u", "a"] == (1, "mixed", False) and got[1, "u", "c"] == (2, "positive", False)
    assert {s for c, _, s in got if c == 2} == {f"s{i:02}" for i in range(10)} and len(got) == 6 + 10


def test_quotes_for_and_against_side_by_side(spark):
    papers = [(1, 1, "结果表明该方法有效并显著提升了全部四个任务的性能。"), (1, 2, "然而实验表明该方法无效, 与我们的预期完全相反的结论。"), (1, 3, "数据显示成功率提升了 20% 并且还在继续上升之中。"), (2, 4, "我们发现这种做法失败了，表明还有很多挑战需要解决。"), (1, 5, None)]
    quotes = research.review(spark.createDataFrame(papers, "cluster long, id long, text string"))
    got = [tuple(r) for r in research.disputed_quotes(quotes).select("cluster", "place", "positive_id", "negative_id").collect()]
    ranks = {r.id: r["rank"] for r in quotes.where("cluster = 1").collect()}
    assert got == [(1, 1, min((1, 3), key=ranks.get), 2)]


def test_numbers_that_may_be_meant(spark):
    claimed = [("a", 100.0), ("a", 7.0), ("b", 50.0), ("c", 1.0), ("d", -10.0), ("e", 0.0)]
    sourced = [("a", x) for x in (60.0, 140.0, 130.0, 101.0, 99.0, 151.0, 49.0, 7.0)] + [("b", 50.1), ("d", -12.0), ("d", 12.0), ("d", 0.0), ("e", 5.0)]
    got = {(r.key, r.value): r.near for r in evidence.near_numbers(spark.createDataFrame(claimed, "key string, value double"), spark.createDataFrame(sourced, "key string, value double")).collect()}
    wanted = {}
    for k, v in claimed:
        own = [x for j, x in sourced if j == k]
        if own and v and not any(abs(x - v) <= 0.005 * abs(v) for x in own):
            wanted[k, v] = sorted({x for x in own if abs(x - v) / abs(v) <= 0.5}, key=lambda x: (abs(x - v) / abs(v), x))[:4]
    assert got == wanted and got["a", 100.0] == [99.0, 101.0, 130.0, 60.0]


def test_equal_names_in_two_folders_are_two_files(spark, tmp_path):
    for folder in ("x", "y/z"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a.txt").write_text(folder)
    got = {r.locator: r.fingerprint for r in research.file_digests(spark, str(tmp_path)).collect()}
    assert got.keys() == {"x/a.txt", "y/z/a.txt"} and len(set(got.values())) == 2


def test_style_reaches_four_votes(spark):
    flat = "综上所述的的的的了的和是在有与的的" * 1 + "。"
    rows = [(1, flat * 12), (2, "Short."), (3, None), (4, "One two three four five. " * 9), (5, "值得注意的是" * 25)]
    got = {r.id: r for r in passages.style(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got[1].votes == 4 and got[1].score == 0.9 and got[1].function_ratio > 0.3
    assert got[4].votes == 2 and got[4].repeat_ratio > 0.62 and got[4].function_ratio == 0 and got.keys() == {1, 4}


def test_organisations_by_their_endings(spark):
    text = "王伟和李娜在北京的字节跳动公司工作，字节跳动公司与清华大学附属医院合作。请联系该研究所、检测/银行、AB3科技公司；在实验室的公司。字节跳动公司很大，大学。"
    rows = [(1, text), (2, None), (3, ""), (4, "某某集团某某集团，某某集团"), (5, "东方集团研究院与东方集团及东方集团研究院")]
    got = {(r.id, r.name): r.n for r in passages.organisations(spark.createDataFrame(rows, "id long, text string")).collect()}
    # a digit and some characters are in no name, so one may begin in the middle
    assert {k[1]: n for k, n in got.items() if k[0] == 1} == {"字节跳动公司": 3, "联系该研究所": 1, "学附属医院": 1, "清华大学": 1}
    assert {k[1]: n for k, n in got.items() if k[0] == 4} == {"某某集团某某集团": 3}  # longer names take those that they contain
    assert {k[1]: n for k, n in got.items() if k[0] == 5} == {"东方集团研究院": 5} and {k[0] for k in got} == {1, 4, 5}
