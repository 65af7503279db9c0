"""Vector index, spelling, titles, link trails, text comparison and clusters against brute force."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.operators import clustering, compare, passages, retrieval, spelling, title_index, trail, vector_index


def vectors_of(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row], 3, "clash") for i, row in zip(ids, x, strict=True)], "item_id long, embedding array<float>, list int, code string")


def test_vector_index_finds_nine_of_ten_and_reads_a_tenth(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.1")
    v = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id AS item_id", "embedding")
    index = vector_index.build(v)
    assert index.table.count() == v.count() == index.rows  # every vector has its place
    q = v.where("item_id % 10 = 0").selectExpr("item_id AS query_id", "embedding")
    exact = {(r.query_id, r.item_id): r.cosine for r in retrieval.knn(v, q, 10).collect()}
    got = {(r.query_id, r.item_id): r.cosine for r in index.search(q, 10).collect()}
    both = set(exact) & set(got)
    assert len(got) == len(exact) and len(both) >= 0.9 * len(exact)
    assert all(abs(exact[k] - got[k]) <= 2e-6 for k in both) and index.share_read(10) < 0.1


def test_vector_index_on_groups_copies_and_hostile_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[i % 12] + 0.1 * rng.standard_normal(16) for i in range(600)]).reshape(600, 16)
    x[:200] = x[0]  # a third of all rows are one vector
    v = vectors_of(spark, x)
    bad = spark.createDataFrame([(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15), (904, [None] * 16), (None, [1.0] * 16), (5, [float(i) for i in range(16)])], "item_id long, embedding array<float>")
    index = vector_index.build(v.select("item_id", "embedding").unionAll(bad))
    assert index.rows == 601 and index.table.where("item_id >= 900").isEmpty()
    q = v.where("item_id % 7 = 0").selectExpr("item_id AS query_id", "embedding")
    got = index.search(q.unionAll(spark.createDataFrame([(990, None), (991, [0.0] * 16), (992, [1.0] * 4)], q.schema)), 10).collect()
    tenth = {r.query_id: r.cosine for r in retrieval.knn(index.table.selectExpr("item_id", "v AS embedding"), q, 10).where("rank = 10").collect()}
    assert {r.query_id for r in got} == tenth.keys() and len(got) == 10 * len(tenth)
    assert np.mean([r.cosine >= tenth[r.query_id] - 1e-5 for r in got]) >= 0.9  # of equal vectors any will do
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 20)
    assert sorted(map(tuple, index.search(q, 10).collect())) == sorted(map(tuple, (r for r in got)))
    alone = index.search(q, 3, skip_self=True)
    assert alone.where("query_id = item_id").isEmpty()
    assert vector_index.build(bad.where("item_id >= 900 AND item_id < 903")) is None
    assert index.search(q.where("false"), 3).isEmpty()
    one = vector_index.build(vectors_of(spark, x[:1]))
    assert [tuple(r) for r in one.search(q.where("query_id = 0"), 5).collect()] == [(0, 0, 1.0, 1)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_spelling_finds_what_comparing_with_every_word_finds(spark):
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcdé"), int(rng.integers(1, 8)))) for _ in range(400)} | {"weather", "words", "数据", "toolongaworditis"}
    counts = {w: int(rng.integers(1, 6)) for w in sorted(words)}
    asked = {"".join(rng.choice(list("abcdé"), int(rng.integers(1, 9)))) for _ in range(200)} | {"qordz", "xeathey", "数剧", "wrods", "a", "", "toolongaworditiz"}
    vocabulary = spark.createDataFrame(list(counts.items()), "term string, cnt long")
    got = spelling.suggestions(spark.createDataFrame([(a, 1) for a in asked] + [(None, 1)], "term string, n long"), spelling.spelling_index(vocabulary), vocabulary)
    wanted = {}
    for a in asked - words:
        if 2 <= len(a) <= 12:
            near = [(-n, d, w) for w, n in counts.items() if 2 <= len(w) <= 12 and (d := edit_distance(a, w)) <= (1 if len(a) <= 3 else 2)]
            if near:
                n, d, w = min(near)
                wanted[a] = (w, d, -n)
    assert {r.term: (r.suggestion, r.distance, r.cnt) for r in got.collect()} == wanted
    assert wanted["qordz"][0] == "words" and wanted["xeathey"][0] == "weather" and len(wanted) > 50


def test_changed_queries_are_run_again(spark):
    typed = spark.createDataFrame([(1, 1, "red"), (1, 2, "aple"), (2, 1, "aple"), (2, 2, "blue"), (3, 1, "aple"), (3, 2, "aple")], "query_id long, nth int, term string")
    found = spark.createDataFrame([("aple", "apple", 1, 9)], "term string, suggestion string, distance long, cnt long")
    postings = spark.createDataFrame([("red", 1), ("apple", 1), ("apple", 2), ("red", 3), ("blue", 3)], "term string, chunk_id long")
    got = {tuple(r) for r in spelling.corrected(typed, found, postings).collect()}
    assert got == {(1, "aple", "apple", "red apple", 1)}


def test_titles_are_ranked_by_the_whole_query(spark):
    items = [(1, "Annual report", "/a/annual.txt"), (2, "The annual annual", None), (3, None, "/a/b.txt"), (4, "ANNUALannual", "/x"), (5, "aaaa", "/y"), (6, "", ""), (7, "report", "/a/annual.txt")]
    index = title_index.build(spark.createDataFrame([(*i, 1, "clash") for i in items], "item_id long, title string, locator string, df long, gram string"))
    asked = [(10, "annual"), (11, "aa"), (12, "aaa"), (13, "nope"), (14, "report"), (15, None)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = [tuple(r) for r in index.search(queries).orderBy("query_id", "rank").collect()]
    rows = {i: ((t or "").lower(), (p or "").lower()) for i, t, p in items}
    size = {i: sum(max(0, len(x) - 2) for x in r) for i, r in rows.items()}
    mean, wanted = sum(size.values()) / len(size), []
    for q, text in asked:
        tf = {i: sum(x[j : j + len(text)] == text for x in r for j in range(len(x))) for i, r in rows.items()} if text and len(text) >= 3 else {}
        tf = {i: n for i, n in tf.items() if n}
        idf = max(1e-6, np.log((len(rows) - len(tf) + 0.5) / (len(tf) + 0.5)))
        scored = sorted((-round(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / mean)), 6), i) for i, n in tf.items())
        wanted += [(q, i, -s, r) for r, (s, i) in enumerate(scored, 1)]
    assert got == wanted and {r[0] for r in got} == {10, 12, 14}
    only = index.search(queries, allowed=spark.createDataFrame([(2,), (7,)], "item_id long")).collect()
    assert {(r.query_id, r.item_id, r.score) for r in only} == {(q, i, s) for q, i, s, _ in wanted if i in (2, 7)}


PAGE = """<a href="#top">x</a><a href='/own'>own</a><a class=q href=https://www.nature.com/articles/1#s1>The <b>study</b>
 itself</a><a href="//arxiv.org/abs/1">pre</a><a href="https://www.nature.com/articles/1">again</a><a href="mailto:a@b.c">m</a><a href="javascript:x()">j</a>
<a href="https://facebook.com/share">f</a><a href="https://blog.csdn.net/p/1">low</a><a href="https://docs.python.org/3/?a=1">doc</a><a href="https://sub.own.org/x">below</a><a href="next.html">n</a>
<a href="https://zhihu.com/q/1">q</a><a href="https://some.where/login">l</a>"""


def test_outlinks_by_tier(spark):
    pages = spark.createDataFrame([(1, "https://www.own.org/a/b.html?x=1", PAGE, "c"), (2, "http://own.org", None, "c"), (3, None, PAGE, "c")], "page_id long, url string, html string, site string")
    got = [(r.target, r.tier, r.text) for r in trail.outlinks(pages).where("page_id = 1").orderBy("place").collect()]
    assert got == [
        ("https://docs.python.org/3/?a=1", "official", "doc"), ("https://arxiv.org/abs/1", "academic", "pre"), ("https://www.nature.com/articles/1", "academic", "again"),  # a mark in the address is noise
        ("https://zhihu.com/q/1", "community", "q"), ("https://blog.csdn.net/p/1", "low", "low"),
    ]
    targets = {r.target: r.text for r in trail.page_links(pages).where("page_id = 1").collect()}
    assert {"https://www.own.org/own", "https://www.own.org/a/next.html"} <= targets.keys() and targets["https://www.nature.com/articles/1#s1"] == "The study itself"
    notes = {r.page_id: (r.links, r.strong, r.note) for r in trail.trail_notes(pages, trail.outlinks(pages)).collect()}
    assert notes[1] == (5, 3, "strong sources") and notes[2] == (0, 0, "no source")


def test_trail_is_a_search_by_levels(spark):
    rng = np.random.default_rng(6)
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (60, 2)) if a != b}
    links = spark.createDataFrame(sorted(edges), "src string, dst string")
    seeds = [(s, s) for s in ("n1", "n2", "n3", "elsewhere")]
    got = {(r.seed, r.url): r.hop for r in trail.trail(trail.both_ways(links), spark.createDataFrame(seeds + seeds[:1], "seed string, url string"), 3).collect()}
    wanted = {}
    for seed, _ in seeds:
        level, seen = {seed}, {seed}
        for hop in range(4):
            wanted |= {(seed, n): hop for n in level}
            level = {y for a, b in edges for x, y in ((a, b), (b, a)) if x in level} - seen
            seen |= level
    assert got == wanted and max(wanted.values()) == 3
    assert trail.trail(trail.both_ways(links), spark.createDataFrame([], "seed string, url string")).isEmpty()


def quadratic(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    return row[-1][-1]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.sampled_from([0, 12, 10**9]))
def test_common_lines_are_as_many_as_there_can_be(a, b, most_bits):
    common = compare.matched(a, b, most_bits)
    assert all(a[i] == b[j] for i, j in common) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(common, common[1:], strict=False))
    assert len(common) <= quadratic(a, b) and (most_bits < 10**9 or len(common) == quadratic(a, b))
    runs = compare.changes(a, b, common)
    out, at = [], 0
    for _, i0, i1, j0, j1 in runs:  # the edits turn one into the other
        out += a[at:i0] + b[j0:j1]
        at = i1
    assert out + a[at:] == b
    assert [t for t, *_ in runs] == ["replace" if i1 > i0 and j1 > j0 else "delete" if i1 > i0 else "insert" for _, i0, i1, j0, j1 in runs]


def test_versions_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    from pyspark.sql import functions as F

    got = compare.compared_texts(compare.versions(docs, F.substring_index("text", "\n", 1))).collect()
    text, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        text[r.doc_id] = r.text
        first.setdefault(r.text.split("\n")[0], r.doc_id)
    wanted = {(first[t.split("\n")[0]], i) for i, t in text.items()}
    assert {(r.a_id, r.b_id) for r in got} == {(a, b) for a, b in wanted if a != b}
    for r in got:
        a, b = text[r.a_id].splitlines(), text[r.b_id].splitlines()
        same = quadratic(a, b)
        assert (r.same_lines, r.added, r.removed) == (same, len(b) - same, len(a) - same) and r.similarity == round(2 * same / max(1, len(a) + len(b)), 4)
        assert r.similarity >= round(difflib.SequenceMatcher(None, a, b, autojunk=False).ratio(), 4)  # a longest subsequence is no shorter
    odd = spark.createDataFrame([(1, 2, None, None), (1, 3, "", "x"), (1, 4, "a\nb\n" * 3000, "b\na\n" * 3000)], "a_id long, b_id long, a_text string, b_text string")
    rows = {r.b_id: r for r in compare.compared_texts(odd).collect()}
    assert rows[2].similarity == 1 and rows[3].similarity == 0 and rows[4].same_lines == 5999 and compare.compared_texts(odd.where("false")).count() == 0


def test_picture_verdicts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, True), (0, False), (5, False), (6, False), (12, False), (13, False)], "d int, same boolean")
    assert [r.v for r in df.select(compare.picture_verdict(F.col("d"), F.col("same")).alias("v")).collect()] == ["identical", "same", "same", "related", "related", "different"]


def greedy(sims, most, least):
    """The closest two groups merged again and again, every pair of members summed each time."""
    groups = [[i] for i in range(len(sims))]
    while len(groups) > most:
        s, i, j = max(((np.mean([sims[p, q] for p in groups[i] for q in groups[j]]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))), default=(-1, 0, 0))
        if s < least:
            break
        groups[-i] += groups.pop(-j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(20))
def test_chains_of_nearest_neighbours_merge_as_greedily(seed):
    rng = np.random.default_rng(seed)
    x = rng.random((int(rng.integers(1, 30)), 6)) ** 3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    for most, least in ((8, 0.18), (1, 0.5), (3, 0.9)):
        assert {frozenset(g) for g in clustering.groups(sims, most, least)} == greedy(sims, most, least)


def test_clusters_have_labels_outliers_and_representatives(spark):
    words = {1: "cat dog", 2: "cat dog", 3: "cat dog fox", 4: "sun sea", 5: "sun sea", 6: "alone", 7: "sun sea sky"}
    cited, year = {1: 3, 2: 9, 3: 9, 4: None, 5: None}, {1: 2001, 2: 1999, 3: None, 4: 2010, 5: 2010, 7: 2012}
    rows = [(1, i, t, 1 / len(w.split()) ** 0.5, cited.get(i), year.get(i)) for i, w in words.items() for t in w.split()] + [(2, 8, "x", 1.0, None, None), (2, 9, "x", 1.0, None, None)]
    got = clustering.cluster_table(spark.createDataFrame(rows, "corpus long, id long, term string, weight double, citations long, year int"), most=3).orderBy("corpus", "cluster").collect()
    assert [(r.corpus, r.cluster, r.label, r.members, r.representative, r.first_year, r.last_year) for r in got] == [
        (1, 0, None, [6], None, None, None), (1, 1, "dog、cat", [1, 2, 3], 2, 1999, 2001), (1, 2, "sun、sea", [4, 5, 7], 4, 2010, 2012), (2, 0, None, [8, 9], None, None, None),
    ]


def test_text_ranks_against_plain_rounds():
    words = list(np.random.default_rng(1).choice(list("abcdefgh"), 60))
    edges = Counter((x, y) for i, a in enumerate(words) for b in words[i + 1 : i + 5] if a != b for x, y in ((a, b), (b, a)))
    weight = {w: 1.0 for w in set(words)}
    for _ in range(10):
        weight = {b: 0.15 + 0.85 * sum(n / sum(m for (x, _), m in edges.items() if x == a) * weight[a] for (a, y), n in edges.items() if y == b) for b in weight}
    got = dict(passages._text_ranks(words, 4, 10, 0.85))
    assert got.keys() == weight.keys() and all(abs(got[w] - weight[w]) < 2e-6 for w in got)
    assert passages._text_ranks([], 4, 10, 0.85) == [] == passages._text_ranks(["a"], 4, 10, 0.85) == passages._text_ranks(["a", "a"], 4, 10, 0.85)
