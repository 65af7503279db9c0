"""Research operators on small fixtures: flags, dates, variants, reviews, exports, several libraries, checks of sources and the built index."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import web
from corvane.operators import evidence, graph, library, passages, research, retrieval, search_index


def test_title_and_rote_flags(spark):
    rows = [
        (1, "震惊！收藏了", "本文转载自某处", 0), (2, "buy buy buy now", "x" * 90, 0), (3, "A short title", "A short title again", 0), (4, "a|b|c|d|e", None, 0), (5, None, "", 0),
        (6, "t", "In conclusion, we delve into it. It is worth noting that" + " so" * 10, 0), (7, "t", "plain words that go on for long enough to count as a text", 3), (8, "t", "short", 5),
    ]
    df = spark.createDataFrame(rows, "id int, t string, s string, others int")
    got = {r.id: (r.f, r.r) for r in df.select("id", web.title_flags(F.col("t"), F.col("s")).alias("f"), web.rote_flags(F.col("t"), F.col("s"), F.col("others")).alias("r")).collect()}
    assert [got[i][0] for i in range(1, 6)] == [["clickbait", "repost"], ["stuffed"], ["echo"], ["joined"], []]
    assert got[6][1] == ["rote_only"] and got[7][1] == ["same_text"] and got[8][1] == []


@pytest.mark.parametrize("written, days", [("2024-01-01", 31), ("2024/1/1", 31), ("2024-01-01T00:00:00Z", 31), ("2024-01-01T12:00:00+0000", 30), ("2023年12月", 62), ("2030-01-01", 0), ("yesterday", None), ("", None), (None, None)])
def test_age_in_days(spark, written, days):
    df = spark.createDataFrame([(written,)], "d string").select(web.age_days(F.col("d"), F.lit("2024-02-01 00:00:00")).alias("n"))
    assert df.first().n == days


def test_plain_abstract(spark):
    df = spark.createDataFrame([("<jats:p>a &lt;b&gt;\n  c &amp;amp; d</jats:p>",), (None,)], "t string")
    assert [r.a for r in df.select(web.plain_abstract(F.col("t")).alias("a")).collect()] == ["a <b> c &amp; d", ""]


def test_query_variants(spark):
    df = spark.createDataFrame([(1, "怎么解决向量检索太慢的问题呢"), (2, "RAG"), (3, "什么是 RAG"), (4, " ")], "query_id long, query string")
    got = {(r.query_id, r.kind): (r.text, r.engines) for r in research.query_variants(df, [("向量", "vector"), ("向量检索", "vector search ")], ["baidu", "bing", "mojeek"]).collect()}
    assert got[1, "trimmed"] == ("解决向量检索太慢的问题", ["baidu"])
    assert got[1, "translated"] == ("怎么解决vector search 太慢的问题呢", ["mojeek"])
    assert got[3, "trimmed"] == ("RAG", ["mojeek"]) and set(k for k in got if k[0] in (2, 4)) == {(2, "original")}


def test_review_and_metrics(spark):
    rows = [("c", 1, "We find that the method works well. Plain sentence of no interest here."), ("c", 2, "However, a limitation of this remains to be seen."), ("c", 3, "nothing"), ("d", 4, "结果表明该方法显著优于以前的方法，提升很大，值得注意。Accuracy is 92.5 %, n = 1,200 and 3 hours"), ("d", 5, None)]
    df = spark.createDataFrame(rows, "cluster string, id long, text string")
    got = {r.id: (r.quote, r.score, r.stance, r["rank"]) for r in research.review(df).collect()}
    assert got[1] == ("We find that the method works well.", 3.0, "neutral", 1) and got[2][1:] == (1.2, "neutral", 2)
    assert got[4][1:] == (5.0, "positive", 1) and set(got) == {1, 2, 4}
    cells = {r.id: r for r in research.metric_table(df).collect()}
    assert (cells[4].accuracy, cells[4].sample, cells[4].time, cells[4].filled) == ("92.5 %", "1,200 例", "3 hours", 3)
    assert cells[5].filled == 0 and cells[1].f1 is None


def test_dates_and_matrix_cells_are_no_quotes(spark):
    topics = spark.createDataFrame([(1, "solar", 1), (1, "solar", 2), (1, "wind", 3), (1, "coal", 4), (1, "coal", 5)], "corpus long, word string, id long")
    sents = spark.createDataFrame([(1, 1, "a", "solar is good"), (1, 2, "b", "solar is cheap"), (1, 3, "a", "wind blows"), (1, 4, "a", "coal is clean"), (1, 5, "b", "coal is not clean")], "corpus long, id long, site string, text string")
    disputes = spark.createDataFrame([(1, 5, 4)], "corpus long, a long, b long")
    dated = sents.select("corpus", "id", "site", F.when(F.col("id") < 3, F.lit("2024-01-02").cast("timestamp")).alias("published"))
    url = F.concat(F.lit("/"), F.col("id").cast("string"))
    bodies = {}
    for name, notes in (("quotes", research.briefing(topics, sents, disputes, r"\d+ ?%")), ("whole", research.briefing(topics, sents, disputes, r"\d+ ?%", dated))):
        full = notes.withColumn("url", url).withColumn("published", F.when(F.col("id") < 3, F.lit("2024-01-02").cast("timestamp")))
        bodies[name] = {t: research.research_notes(full, t).first().body for t in research.TEMPLATES}
    assert all(bodies["whole"][t] == bodies["quotes"][t] for t in ("timeline", "compare", "qa"))
    assert "| wind | a | - |" in bodies["whole"]["compare"] and "| coal | - | a, b |" in bodies["whole"]["compare"]
    points = bodies["whole"]["points"]
    assert "- wind: silent [b]()" in points and "- coal: mixed [b]()" in points and "- 2024-01-02 [a](/1)" in points
    assert "silent" not in bodies["quotes"]["points"]


def test_briefing_and_its_exports(spark):
    topics = spark.createDataFrame([(1, "solar", 1), (1, "solar", 2), (1, "wind", 3), (1, "coal", 4), (1, "coal", 5)], "corpus long, word string, id long")
    sents = spark.createDataFrame([(1, 1, "a", "solar is good"), (1, 2, "b", "solar is cheap, 5 %"), (1, 3, "a", "wind blows"), (1, 4, "a", "coal is clean"), (1, 5, "b", "coal is not clean")], "corpus long, id long, site string, text string")
    disputes = spark.createDataFrame([(1, 5, 4)], "corpus long, a long, b long")
    notes = research.briefing(topics, sents, disputes, r"\d+ ?%")
    assert {(r.section, r.id) for r in notes.collect()} == {("consensus", 1), ("consensus", 2), ("open", 3), ("dispute", 4), ("dispute", 5), ("number", 2)}
    full = notes.withColumn("url", F.concat(F.lit("/"), F.col("id").cast("string"))).withColumn("published", F.when(F.col("id") < 3, F.lit("2024-01-02").cast("timestamp")))
    bodies = {t: research.research_notes(full, t).first().body for t in research.TEMPLATES}
    for quote in ("solar is good", "coal is not clean", "wind blows"):
        assert all(quote in bodies[t] for t in ("points", "timeline", "qa"))
    assert bodies["timeline"].index("**2024-01-02** solar is good") < bodies["timeline"].index("wind blows")
    assert "| solar | a, b | - |" in bodies["compare"] and "| coal | - | a, b |" in bodies["compare"]
    with pytest.raises(ValueError):
        research.research_notes(full, "poem")
    body = spark.createDataFrame([(1, "## <b>\nline")], "corpus long, body string")
    content = {f: bytes(research.research_files(body, f, "T & t").first().content) for f in ("markdown", "html", "single-html", "json", "docx")}
    assert content["markdown"] == b"# T & t\n\n## <b>\nline" and b"&lt;b&gt;" in content["html"] and b"<style>" in content["single-html"]
    assert json.loads(content["json"]) == {"title": "T & t", "body": "## <b>\nline"}
    assert b"T &amp; t" in zipfile.ZipFile(io.BytesIO(content["docx"])).read("word/document.xml")


def test_libraries_that_fail_leave_others_alone(spark, tmp_path):
    spark.createDataFrame([(1, "solar power and solar heat"), (2, "thermosolarium")], "id long, text string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1,)], "other long").write.parquet(str(tmp_path / "b"))
    rows, failed = research.federated(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "c": str(tmp_path / "c")}, lambda df: df.select("id", "text"))
    assert set(failed) == {"b", "c"}
    q = spark.createDataFrame([(9, "solar", ["solar"])], "query_id long, query string, terms array<string>")
    assert [(r.id, r.score, r["rank"]) for r in research.federated_hits(rows, q).orderBy("rank").collect()] == [("1", 2, 1), ("2", -1000, 2)]
    assert research.federated(spark, {}, lambda df: df) == (None, {})


def test_sources_manifest_and_trash(spark, tmp_path):
    for name, text in (("x.txt", "one"), ("y.txt", "two")):
        (tmp_path / name).write_text(text)
    found = research.file_digests(spark, str(tmp_path))
    recorded = spark.createDataFrame([("x.txt", found.where("locator = 'x.txt'").first().fingerprint), ("y.txt", "other"), ("z.txt", "gone"), ("w.txt", None)], "locator string, fingerprint string")
    assert dict(research.verify_sources(recorded, found).collect()) == {"x.txt": "unchanged", "y.txt": "changed", "z.txt": "missing", "w.txt": "missing"}
    assert dict(research.verify_sources(spark.createDataFrame([("x.txt", None)], "locator string, fingerprint string"), found).collect()) == {"x.txt": "unverifiable", "y.txt": "new"}
    trash = spark.createDataFrame([(1, "/a"), (2, "/b")], "item_id long, locator string")
    got = research.restored(trash, spark.createDataFrame([(1,), (2,), (3,), (1,)], "item_id long"), spark.createDataFrame([("/b",)], "locator string"))
    assert {r.item_id: (r.locator, r.action) for r in got.collect()} == {1: ("/a", "re-ingest"), 2: ("/b.restored", "copy-out"), 3: (None, "gone")}


def test_index_progress(spark):
    c = spark.createDataFrame([(1,), (1,), (2,), (3,)], "item_id long")
    v = spark.createDataFrame([(1,), (2,), (3,), (3,)], "item_id long")
    assert {r.item_id: r.status for r in research.index_progress(c, v).collect()} == {1: "partial", 2: "ready", 3: "broken"}


def test_bursts_and_frame_runs(spark):
    posts = [(i, "t", f"s{i}", 10 + i % 3) for i in range(6)] + [(100, "t", "s0", 40), (101, "u", "s1", 11)]
    df = spark.createDataFrame(posts, "post_id long, topic string, site string, hour long")
    assert {r.post_id for r in evidence.bursts(df, 2, 6).collect()} == set(range(6))
    assert evidence.bursts(df, 1, 6).count() == 0
    frames = [(1, i, x) for i, x in enumerate("abcdz")] + [(2, i, x) for i, x in enumerate("qabcyz")]
    runs = library.frame_runs(spark.createDataFrame(frames, "video long, i long, look string")).collect()
    assert [(r.a, r.b, r.shift, r.start, r.end, r.n) for r in runs] == [(1, 2, -1, 0, 2, 3)]


def test_built_index_follows_its_source(spark, tmp_path):
    path = str(tmp_path / "docs")
    chunks = lambda: spark.read.parquet(path)
    spark.createDataFrame([(1, 1, "red apple red"), (2, 1, "green apple"), (3, 2, None)], "chunk_id long, item_id long, text string").write.parquet(path)
    index = search_index.built(spark, path, chunks)
    assert search_index.built(spark, path, chunks) is index
    assert {(r.term, r.chunk_id, r.tf) for r in index.of(spark.createDataFrame([("red",), ("apple",), ("none",)], "term string")).collect()} == {("red", 1, 2), ("apple", 1, 1), ("apple", 2, 1)}
    assert dict(index.stats.collect()) == {1: 3, 2: 2, 3: 0}
    spark.createDataFrame([(4, 3, "red")], "chunk_id long, item_id long, text string").write.mode("append").parquet(path)
    assert search_index.built(spark, path, chunks).stats.count() == 4


def test_knn_over_several_blocks_of_queries(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    q = v.select(F.col("item_id").alias("query_id"), "embedding").where("query_id < 20")
    whole = sorted(map(tuple, retrieval.knn(v, q, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 6)
    assert sorted(map(tuple, retrieval.knn(v, q, 4).collect())) == whole and len(whole) == 80


def test_every_near_pair_of_hashes(spark):
    """Every pair of hashes within ten bits."""
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 62, 20)]
    hashes = [b ^ sum(1 << int(i) for i in rng.choice(62, int(rng.integers(0, 8)), replace=False)) for b in base for _ in range(8)]
    hashes += hashes[:5]
    rows = list(enumerate(hashes))
    least = {}
    for i, h in rows:
        least.setdefault(h, i)
    wanted = {(i, j, (a ^ b).bit_count()) for a, i in least.items() for b, j in least.items() if i < j and (a ^ b).bit_count() <= 10} | {(least[h], i, 0) for i, h in rows if least[h] != i}
    found = {tuple(r) for r in graph.near_pairs(spark.createDataFrame(rows, "item_id long, hash long")).collect()}
    assert found == wanted and len(wanted) > 200


def test_keywords_are_taken_in_turn(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 3)], "id long, term string, rank long")
    b = spark.createDataFrame([(1, "y", 1), (1, "w", 2)], "id long, term string, rank long")
    assert [r.term for r in passages.interleaved(a, b, 4).orderBy("rank").collect()] == ["x", "y", "w", "z"]


def test_near_pairs_send_no_flips_through_the_driver(spark):
    """An explode makes far more rows than its plan's estimate, so what holds all flipped values isn't broadcast; items of one hot value are all compared."""
    rows = [(i, (7 << 48) | (i << 16) | (i % 3)) for i in range(300)]
    found = graph.near_pairs(spark.createDataFrame(rows, "item_id long, hash long"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [band" not in plan and "BroadcastHashJoin [value" not in plan
    wanted = {(i, j, (a ^ b).bit_count()) for i, a in rows for j, b in rows if i < j and (a ^ b).bit_count() <= 10}
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)


def test_frame_runs_of_every_length(spark):
    """Runs against a plain walk along the diagonals, longer than the stretch that is compared where videos meet; a frame that is missing ends a run. No pair is shuffled."""
    rng = np.random.default_rng(5)
    base = [str(x) for x in rng.integers(0, 3, 40)]
    videos = {1: base, 2: base[:15] + ["q"] + base[15:], 3: [str(x) for x in rng.integers(0, 3, 40)], 4: base[5:30]}
    frames = [(v, i, x) for v, looks in videos.items() for i, x in enumerate(looks) if (v, i) not in {(2, 20), (3, 7)}]
    look = {(v, i): x for v, i, x in frames}
    wanted = set()
    for (a, i), x in look.items():
        for b, j in [(b, j) for b, j in look if b > a and look[b, j] == x]:
            if look.get((a, i - 1)) is not None and look.get((a, i - 1)) == look.get((b, j - 1)):
                continue
            n = 0
            while look.get((a, i + n)) is not None and look.get((a, i + n)) == look.get((b, j + n)):
                n += 1
            if n >= 2:
                wanted.add((a, b, i - j, i, i + n - 1, n))
    runs = library.frame_runs(spark.createDataFrame(frames, "video long, i long, look string"))
    assert sorted(map(tuple, runs.collect())) == sorted(wanted) and max(n for *_, n in wanted) > 12
    assert "Aggregate" not in runs._jdf.queryExecution().sparkPlan().toString()


def test_fold_of_equally_long_snippets(spark):
    """One address with two snippets of one length: the last one names it, in whatever order the rows come."""
    rows = [(1, e, 1, "x.org/a", "http://x.org/a", "a long title", s, "x.org") for e, s in enumerate(["about 10", "about 30", "about 20"])]
    schema = "query_id long, engine int, pos long, canonical string, url string, title string, snippet string, site string"
    keys = {evidence.fold(spark.createDataFrame(r, schema).coalesce(1)).first().key for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert keys == {evidence.fold(spark.createDataFrame(rows[1:2], schema)).first().key}


def test_conflicts_count_words_as_sets(spark):
    """Each topic's negated sentences against others of another site, with the words that both hold; no row is made for a shared word."""
    said = [(1, 1, "a", "green apples never fall"), (1, 2, "b", "green apples fall often"), (1, 3, "a", "green apples fall"), (2, 1, "a", "green apples never fall"), (2, 4, "b", "nothing of that kind"), (1, 5, "b", "")]
    found = evidence.conflicts(spark.createDataFrame(said, "topic long, id long, site string, text string"), 0.5)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 2, 3)}
    assert "Generate" not in found._jdf.queryExecution().sparkPlan().toString()


def test_conflicts_with_a_few_texts(spark):
    """Many texts against a few by topic: as plain counting says, and without a shuffle of texts or pairs."""
    told = [(-1, "web1", ["solar", "wind"], ["green", "apples", "fall"]), (-2, "web2", ["coal"], ["green", "apples"]), (-3, "local", ["solar"], ["green", "apples"]), (-4, "web1", ["solar"], ["other"])]
    few = [(1, "solar", 10, "local", ["green", "apples"]), (1, "solar", 11, "local", ["pears"]), (2, "wind", 10, "local", ["green", "apples"]), (3, "coal", 12, "local", ["apples", "plums", "pears", "figs"])]
    found = evidence.conflicts_with(spark.createDataFrame(told, "id long, site string, words array<string>, terms array<string>"), spark.createDataFrame(few, "topic long, word string, id long, site string, terms array<string>"), 0.5)
    assert sorted(map(tuple, found.collect())) == [(1, -1, 10, 2), (2, -1, 10, 2), (3, -2, 12, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_mentions_are_dealt_by_the_size_of_the_table(spark, sf_dir, monkeypatch):
    """As many parts as the table has blocks of rows, and the same pairs as with few."""
    from corvane.plans import views

    few = sorted(map(tuple, graph.cooccurrence(views.mentions(spark, sf_dir)).collect()))
    monkeypatch.setattr(views, "MENTION_ROWS", 500)
    n = views.mention_tasks(spark, sf_dir)
    mentions = views.mentions(spark, sf_dir)
    edges = graph.cooccurrence(mentions, tasks=n)
    assert n > 10 and mentions.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == n
    assert sorted(map(tuple, edges.collect())) == few


def test_an_item_counts_with_all_its_entities(spark, monkeypatch):
    """Every pair of every item, also of one that is cut into blocks, with duplicates and without what has no id; capped only where that is asked for."""
    from itertools import combinations

    rows = [(1, e) for e in range(40)] + [(2, e) for e in range(5, 45, 2)] + [(3, 7), (3, 7), (3, 9), (4, 1), (None, 1), (None, 2), (5, None), (5, 3)]
    mentions = spark.createDataFrame(rows, "item long, entity long")
    held = {}
    for i, e in rows:
        if i is not None and e is not None:
            held.setdefault(i, set()).add(e)

    def wanted(most):
        out = {}
        for es in held.values():
            for p in combinations(sorted(es)[:most], 2):
                out[p] = out.get(p, 0) + 1
        return out

    for block, tasks in ((512, None), (8, None), (8, 6), (1, 3)):
        monkeypatch.setattr(graph, "BLOCK", block)
        for most in (None, 12):
            assert {(r.lo, r.hi): r.weight for r in graph.cooccurrence(mentions, most, tasks).collect()} == wanted(most)
