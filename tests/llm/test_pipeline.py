"""The pipeline on the given tables: each stage keeps what it should of its own input.

The tables have few labels, so a quarter of the toxic documents, which aren't learned from, are mostly missed.
"""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontamination, mixing

LARGER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").withColumn("text", F.col("text"))
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "mixing"]

    safe = steps["toxicity"](spark, docs, LARGER)
    assert safe.columns == docs.columns
    gone = docs.join(safe, "doc_id", "left_anti").join(labels, "doc_id")
    known = labels.groupBy("toxic").count().collect()
    toxic = {r.toxic: r["count"] for r in known}
    caught = {r.toxic: r["count"] for r in gone.groupBy("toxic").count().collect()}
    assert caught.get(1, 0) >= 0.7 * toxic[1] and caught.get(0, 0) <= 0.03 * toxic[0]

    lines = steps["line_dedup"](spark, docs, LARGER)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    assert lines.where("n_chars <> length(text)").count() == 0

    single = steps["simhash_dedup"](spark, docs, LARGER)
    assert single.count() <= docs.select("text").distinct().count()
    assert single.select("text").distinct().count() == single.count()

    clean = steps["decontamination"](spark, docs, LARGER)
    assert decontamination.contaminated_pairs(clean, spark.read.parquet(f"{LARGER}/benchmark.parquet")).count() == 0
    assert clean.count() >= 0.9 * docs.count()


def test_run_and_empty_tables(spark):
    out = corpus_pipeline.run(spark, LARGER)
    assert out.count() > 500 and {"doc_id", "text", "taken", "target"} <= set(out.columns)
    empty = spark.read.parquet(f"{LARGER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, LARGER).count() == 0


def test_stages_know_rows_by_id_and_text(spark, tmp_path):
    prose = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "pqrstu"}
    near = prose["p"].replace("p30 ", "changed ")
    item = " ".join(f"leak{i}" for i in range(30))
    rows = [
        (None, prose["q"]), (None, prose["r"]), (None, prose["r"]),  # null ids: clean, and a row repeated whole
        (5, prose["s"]), (5, prose["s"]),  # repeated rows
        (2, prose["p"]), (7, near), (7, prose["t"]),  # one id with two texts, one of them a near copy
        (None, prose["u"]), (9, prose["u"]),  # an id goes before none
        (None, f"{item} and more"), (8, f"before {item}"), (8, "a clean text that has the id of a leaked one"),
        (None, None), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    single = corpus_pipeline.one_of_each_group(spark, docs, LARGER)
    assert single.columns == docs.columns
    kept = sorted(((r.doc_id, r.text or "") for r in single.collect()), key=str)
    leaked = [(8, f"before {item}")]
    clean = [(8, "a clean text that has the id of a leaked one")]
    assert kept == sorted([(None, prose["q"]), (None, prose["r"]), (5, prose["s"]), (2, prose["p"]), (7, prose["t"]), (9, prose["u"]), (None, "")] + leaked + clean, key=str)

    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(rows[:10] + rows[12:], key=str)


def test_columns_with_names_used_inside_stay_as_they_are(spark, tmp_path):
    words = lambda k: " ".join(f"{k}{i}" for i in range(50))
    line = "a line that is long enough to be a key of its own, in five documents"
    texts = [f"{words(k)}\n{line}" for k in "abcdef"]
    texts += [texts[0] + " x", None]
    own = {"toxicity": 7.5, "_d": "mine", "_t": 3, "_n": 4, "_keep": "k", "_text": "t", "row": 1, "group": "g", "best": 2, "nodes": 5, "a.b": 6}
    docs = spark.createDataFrame([(i, t, "s", *own.values()) for i, t in enumerate(texts)], "doc_id long, text string, source string, toxicity double, _d string, _t int, _n int, _keep string, _text string, row int, group string, best int, nodes int, `a.b` int")
    spark.createDataFrame([(1, words("c"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all({c: r[c] for c in own} == own for r in rows), name
        kept = {r.doc_id: r.text for r in rows}
        if name == "line_dedup":
            assert line not in kept[0] and line in kept[5] and kept[7] is None
        elif name == "simhash_dedup":
            assert 0 in kept and 6 not in kept
        elif name == "decontamination":
            assert 2 not in kept and len(kept) == 7


def test_mixing_stage_makes_the_mix(spark):
    rows = [(i, "".join(f" w{i}-{j}\n" for j in range(1 + i % 13)), s) for s, ids in (("big", range(200)), ("small", range(200, 230)), (None, range(230, 260))) for i in ids] + [(None, "a b  c", "small"), (300, None, "big"), (301, " ", "small")]
    docs = spark.createDataFrame([(i, t, None, s, 1) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    decided = {(r.doc_id, r.text): r for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.mix_sources(spark, docs, LARGER).collect()
    words = Counter()
    by_doc = defaultdict(list)
    for r in out:
        words[r.source] += len(r.text.split())
        by_doc[r.doc_id].append(r)
        assert r.n_chars == len(r.text)
    assert words == {r.source: round(r.target) for r in out} and max(len(x) for x in by_doc.values()) == 3
    cut = 0
    for (i, text), r in decided.items():
        got = [x.text for x in sorted(by_doc[i], key=lambda x: x.repetition)]
        whole, rest = divmod(r.taken, r.size) if r.size else (0, 0)
        assert got[:whole] == [text] * whole and len(got) == whole + (rest > 0)
        if rest:
            cut += 1
            assert text.startswith(got[-1]) and len(got[-1].split()) == rest
    assert cut


def test_stages_against_brute_force(spark):
    """Line dedup, near duplicates and decontamination on all rows of the given table."""
    from test_dedup import brute_lines, brute_sets, components_of, jaccard

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    steps = dict(corpus_pipeline.STAGES)

    lined = {r.doc_id: r.text for r in steps["line_dedup"](spark, docs, LARGER).select("doc_id", "text").collect()}
    from hashlib import sha256

    assert {i: sha256((t or "").encode()).hexdigest() for i, t in lined.items()} == {i: d for i, _, _, d in brute_lines(rows, 40, 5)}

    sets = brute_sets([t for _, t in rows])
    holders = defaultdict(list)
    for n, own in enumerate(sets):
        for x in own:
            holders[x].append(n)
    met = Counter((a, b) for own in holders.values() for k, b in enumerate(own) for a in own[:k])
    links = [p for p in met if jaccard(sets[p[0]], sets[p[1]]) >= 0.8] + [(a, b) for b in range(len(sets)) for a in range(b) if not sets[a] and not sets[b]]
    root = components_of(range(len(sets)), links)
    best = {}
    for n, (i, _) in enumerate(rows):
        best[root[n]] = min(i, best.get(root[n], i))
    assert sorted(r.doc_id for r in steps["simhash_dedup"](spark, docs, LARGER).select("doc_id").collect()) == sorted(best.values())

    items = [words(r.text) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    of_items = [grams(v) for v in items]
    held = defaultdict(set)
    for k, own in enumerate(of_items):
        for g in own:
            held[g].add(k)
    leaked = set()
    for i, t in rows:
        w = words(t)
        for k in {k for g in grams(w) for k in held.get(g, ())}:
            n = min(len(items[k]), len(w))
            for at in range(len(w) - n + 1):
                own = grams(w[at : at + n])
                both = sum((own & of_items[k]).values())
                if both and both / sum((own | of_items[k]).values()) >= 0.8:
                    leaked.add(i)
                    break
    left = {r.doc_id for r in steps["decontamination"](spark, docs, LARGER).select("doc_id").collect()}
    assert {i for i, _ in rows} - left == leaked and leaked


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())
