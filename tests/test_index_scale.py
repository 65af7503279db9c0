"""The index's work follows the number of postings: what is written for which question, and in how many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import answers, passages, retrieval, search_index, trail


def _index(spark, n=60):
    rows = [(i, i // 3, "the red" if i % 2 else "the blue the") for i in range(n)]
    return search_index.build(spark.createDataFrame(rows, "chunk_id long, item_id long, text string"))


def test_terms_alone_write_no_postings(spark):
    index = _index(spark)
    asked = spark.createDataFrame([(1, "the"), (1, "none")], "query_id long, term string")
    assert {tuple(r) for r in answers.split_terms(index.terms, asked).collect()} == {(1, "the", 60), (1, "none", 0)}
    assert {tuple(r) for r in index.terms.collect()} == {("the", 60, 90), ("red", 30, 30), ("blue", 30, 30)}
    assert "postings" not in index.__dict__


def test_a_frequent_terms_postings_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(search_index, "FOLDER_ROWS", 20)
    monkeypatch.setattr(search_index, "TASK_ROWS", 10)
    index = _index(spark)
    files = index.postings.where("term = 'the'").select(F.input_file_name()).distinct().count()
    assert files > 1 and index.postings.count() == 120 and index.folders == 8
    asked = spark.createDataFrame([(1, "the"), (2, "the"), (2, "red")], "query_id long, term string")
    hits = index.matched(asked)
    assert hits.rdd.getNumPartitions() >= 15 and hits.count() == 150
    found = retrieval.bm25(index, asked)
    assert found.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 60), (2, 30)]
    assert found.rdd.getNumPartitions() >= 15  # summed where postings were dealt
    both = retrieval.match_alternatives(index, asked.withColumn("alternative", F.col("term")))
    assert both.groupBy("query_id").count().orderBy("query_id").collect() == [(1, 60), (2, 30)]


def test_a_search_done_once_writes_no_postings(spark):
    """The same hits, counts and frequencies as over postings and the table of terms by item, which are read if they are there."""
    index = _index(spark)
    asked = spark.createDataFrame([(1, "the"), (2, "the"), (2, "red"), (3, "none")], "query_id long, term string")
    hits = sorted(map(tuple, retrieval.bm25(index, asked, once=True).collect()))
    few = spark.createDataFrame([(1,), (3,), (3,)], "id long")
    counts, df = sorted(map(tuple, index.item_terms(few).collect())), sorted(map(tuple, index.item_frequencies().collect()))
    assert not {"postings", "_item_terms"} & index.__dict__.keys()
    assert hits == sorted(map(tuple, retrieval.bm25(index, asked).collect())) and len(hits) == 90
    assert counts == sorted(tuple(r) for r in index.item_terms().collect() if r.id in (1, 3)) and len(counts) == 6
    assert {"postings", "_item_terms"} <= index.__dict__.keys() and df == sorted(map(tuple, index.item_frequencies().collect())) == [("blue", 20), ("red", 20), ("the", 20)]
    assert hits == sorted(map(tuple, retrieval.bm25(index, asked, once=True).collect()))


def test_frequencies_count_items(spark):
    """Over chunks in any order and several batches, with an item without terms and one without id."""
    rows = [(1, 1, "red tea"), (2, 2, "tea"), (3, 1, "tea red sun"), (4, 3, "..."), (5, None, "sun"), (6, None, "sun tea"), (7, 2, "中文字")]
    index = search_index.build(spark.createDataFrame(rows, "chunk_id long, item_id long, text string"))
    assert {tuple(r) for r in index.item_frequencies().collect()} == {("red", 1), ("tea", 3), ("sun", 2), ("中文", 1), ("文字", 1)}


def test_clusters_write_no_postings(spark, sf_dir):
    from corvane.plans import catalogue, views

    index = views.index(spark, sf_dir)
    kept = {k: index.__dict__.pop(k) for k in ("postings", "_item_terms") if k in index.__dict__}
    found = catalogue.QUERIES["tfidf_cluster"](spark, sf_dir).count()
    assert found and not {"postings", "_item_terms"} & index.__dict__.keys()
    index.__dict__.update(kept)


def test_plain_text_has_the_same_tokens(spark):
    texts = spark.createDataFrame([("It's A-1_b2  C",), ("İt's A-1_b2 é C",), ("",), (None,), ("中文字 Ab",)], "text string")
    assert [r[0] for r in texts.select(tokens(F.col("text"))).collect()] == [["it", "s", "a", "1", "b2", "c"], ["i", "t", "s", "a", "1", "b2", "e", "c"], [], [], ["中文", "文字", "ab"]]


def test_more_terms_than_a_list_holds(spark, monkeypatch):
    monkeypatch.setattr(search_index, "MOST_LISTED", 1)
    index = _index(spark)
    asked = spark.createDataFrame([(1, "the"), (2, "the"), (2, "red")], "query_id long, term string")
    assert index.matched(asked).count() == 150 and index.of(asked).count() == 90


def test_tfidf_of_some_documents_counts_all(spark):
    counts = spark.createDataFrame([(1, "red", 1), (1, "tea", 2), (2, "tea", 1), (3, "tea", 1), (3, "sun", 4)], "id long, term string, c long")
    docs = counts.select("id").distinct()
    whole = {tuple(r) for r in passages.tfidf(counts, docs).collect()}
    some = {tuple(r) for r in passages.tfidf(counts, docs, only=spark.createDataFrame([(1,), (3,), (3,)], "id long")).collect()}
    assert some == {r for r in whole if r[0] != 2} and len(some) == 4


def test_a_hops_tasks_follow_what_it_reaches(spark, monkeypatch):
    monkeypatch.setattr(trail, "TASK_ROWS", 100)
    tasks = []
    dealt = type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda self, n, *by: tasks.append(n) or dealt(self, n, *by))
    links = spark.createDataFrame([(f"p{i}", "hub") for i in range(40)], "src string, dst string")
    found = trail.trail(trail.both_ways(links), links.select(F.col("src").alias("seed"), F.col("src").alias("url")), 2)
    assert found.count() == 40 * 41 and found.where("hop = 2").count() == 40 * 39
    assert max(tasks) >= 40 * 40 // 100


def test_a_trail_keeps_sets_and_not_rows(spark, monkeypatch):
    """What a round writes grows with the addresses, also past a hub, and no shuffle files stay behind it."""
    rounds = []
    kept = trail.written
    monkeypatch.setattr(trail, "written", lambda df, name: rounds.append((name, spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"), kept(df, name))) or rounds[-1][2])
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    links = spark.createDataFrame([(f"p{i}", "hub") for i in range(40)], "src string, dst string")
    found = trail.trail(trail.both_ways(links), links.select(F.col("src").alias("seed"), F.col("src").alias("url")), 2)
    assert found.count() == 40 * 41
    assert [df.count() for name, _, df in rounds if name == "trail"] == [1, 40] and {x for _, x, _ in rounds} == {"true"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_a_trail_in_many_blocks_and_parts(spark, monkeypatch):
    """As a search by levels finds it, with the first of both ways, seeds of several addresses or without links, and links one way only."""
    rng = np.random.default_rng(3)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 120, (150, 2)) if a != b})
    ways = sorted({(a, b, w) for a, b in edges for w in (("out",), ("back",), ("back", "out"))[rng.integers(0, 3)]})
    seeds = [(f"s{i}", f"n{a}") for i, a in enumerate(rng.integers(0, 130, 60))] + [("s1", "n5"), ("s1", "n6"), ("none", "elsewhere")]
    wanted = {}
    for seed in {s for s, _ in seeds}:
        level = {u for s, u in seeds if s == seed}
        wanted |= {(seed, u): (0, "seed") for u in level}
        for hop in (1, 2, 3, 4):
            new = {}
            for a, b, w in ways:
                if a in level and (seed, b) not in wanted:
                    new[b] = min(w, new.get(b, w))
            wanted |= {(seed, u): (hop, w) for u, w in new.items()}
            level = set(new)
    for name, n in (("SEEDS", 25), ("PART_LINKS", 30), ("LISTED", 5)):
        monkeypatch.setattr(trail, name, n)
    found = trail.trail(spark.createDataFrame(ways, "src string, dst string, way string"), spark.createDataFrame(seeds, "seed string, url string"), 4).collect()
    assert {(r.seed, r.url): (r.hop, r.way) for r in found} == wanted and len(found) == len(wanted) and {h for h, _ in wanted.values()} == {0, 1, 2, 3, 4}


def test_sets_of_places_are_packed():
    for places in ([0], [65535], [0, 1, 255, 256, 511, 40000, 65535], list(range(65536))):
        assert trail._unpack(trail._pack(np.array(places))).tolist() == places
    assert trail._pack(np.array([258])) == bytes([1, 2])  # as a start is written
