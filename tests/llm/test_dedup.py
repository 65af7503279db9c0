"""Deduplication operators against brute force, on given tables and on small hostile fixtures."""

from __future__ import annotations

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import embedding_dedup, line_dedup, repeats, simhash, substring_dedup, suffix_dedup
from corvane.llm.components import connected_components
from corvane.llm.groups import paired_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, part string"


def documents(spark, texts, ids=None):
    """A table with extra columns whose names clash with those used inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "s", 0, 1, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def hostile(seed=1, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ß", "日本", "a" * 50]
    common = " ".join(rng.choice(vocabulary, 60))
    texts = [None, "", " ", "one", "\n\n", "x" * 3000, "ab " * 500, "z " * 90]
    for i in range(n):
        t = " ".join(rng.choice(vocabulary, int(rng.integers(1, 90))))
        if i % 3 == 0:
            t = t + "  " + common + "\t" + t
        if i % 7 == 0:
            t = texts[-1]
        texts.append(t)
    return texts


def components_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_words(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(xxhash.xxh3_128_intdigest(b[i : i + window]) for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[xxhash.xxh3_128_intdigest(b[i : i + window])] > 1:
                gone[i : i + window] = True
        spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
        out.append((len(b), int(gone.sum()), spans, sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def rows_by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [35, 9])
def test_substring_dedup_is_exact(spark, sf_dir, window):
    for texts in (hostile(), [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]):
        got = {r[0]: tuple(r[1:]) for r in substring_dedup.substring_digests(documents(spark, texts), window).collect()}
        assert [got[i] for i in range(len(texts))] == brute_words(texts, window)


@pytest.mark.parametrize("window", [400, 70])
def test_suffix_dedup_is_exact(spark, sf_dir, window):
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    for texts in (hostile(2), given):
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_digests(documents(spark, texts), window).collect()}
        assert [got[i] for i in range(len(texts))] == brute_bytes(texts, window)


def test_long_documents_are_cut_into_steps(monkeypatch):
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, 5, 3000).astype(np.uint64)
    borders = np.array([0, 700, 700, 3000])
    whole = repeats.anchors(tokens, borders, 20, 4)
    monkeypatch.setattr(repeats, "_STEP", 256)
    steps = repeats.anchors(tokens, borders, 20, 4)

    def per_window(x):
        return {(int(r), int(lo) + i): (int(lo + off), int(h)) for r, lo, off, n, h, _ in zip(*x, strict=True) for i in range(n)}

    assert per_window(whole) == per_window(steps)


def test_repeated_rows_and_ids(spark):
    text = " ".join(f"u{i}" for i in range(50))
    docs = documents(spark, [text, text, text + " tail", None, None], [7, 7, 7, None, 1])
    got = rows_by_id(substring_dedup.substring_digests(docs).select("doc_id", "n_words", "n_removed"))
    assert got == sorted([(7, 50, 50), (7, 50, 50), (7, 51, 50), (None, 0, 0), (1, 0, 0)], key=str)
    empty = documents(spark, [])
    assert substring_dedup.substring_digests(empty).count() == 0
    assert suffix_dedup.suffix_digests(empty).count() == 0


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_finds_every_pair_within_three_bits(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()] + hostile(4)
    prints = [brute_fingerprint(t) for t in texts]
    links = [(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3]
    wanted = components_of(range(len(texts)), links)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {i: (prints[i], wanted[i]) for i in range(len(texts))}


def test_fingerprint_is_xxhash64_of_spark(spark):
    row = spark.sql("SELECT xxhash64('the quick fox') AS h").first()
    assert simhash.shingle_hashes(b"The QUICK\tfox", 3).view(np.int64).tolist() == [row.h]


def test_gray_index_links_like_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)) for _ in range(3000)], dtype=np.uint64)
    fp = base[rng.integers(0, 40, 3000)] ^ flips
    none, within = np.zeros((3000, 0), np.uint64), np.full(3000, 2, np.int8)
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(far <= 3), strict=True) if i < j]
    wanted = components_of(range(3000), links)
    assert simhash.linked(fp, none, within, 3).tolist() == [wanted[i] for i in range(3000)]


def test_wide_simhash_separates_similarities(spark):
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in rng.integers(0, 10**6, 400)]
    near, far = list(base), list(base)
    for i in range(0, 400, 80):
        near[i] = "changed"
    for i in range(0, 400, 8):
        far[i] = "changed"
    other = [f"o{i}" for i in rng.integers(0, 10**6, 400)]
    docs = documents(spark, [" ".join(x) for x in (base, near, far, other)])
    got = dict(simhash.similar_documents(docs).select("doc_id", "component_id").collect())
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_hot_keys_are_paired_once(spark):
    df = spark.range(50).select(F.lit(1).alias("key"), F.col("id").alias("x"))
    parts = paired_blocks(df, "key", "x", 8).select("part", "side", "x").collect()
    pairs = Counter()
    for p in {r.part for r in parts}:
        own = [(r.side, r.x) for r in parts if r.part == p]
        pairs.update(frozenset((a, b)) for i, (s, a) in enumerate(own) for t, b in own[:i] if s == 2 or s != t)
    assert len(pairs) == 50 * 49 // 2 and set(pairs.values()) == {1}


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 620)] + [(900, x) for x in range(901, 960)]
    wanted = components_of({x for e in edges for x in e}, edges)
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: c for n, c in wanted.items() if n in got} and {n for e in edges if e[0] != e[1] for n in e} == set(got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_links(spark, sf_dir):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 64))
    rows = [(i, (centre[i % 5] + rng.normal(size=64) * rng.choice([0.05, 0.25, 0.33])).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(1000, None, 0), (1001, [0.0] * 64, 0), (1002, [float("nan")] * 64, 0), (1003, rows[0][1], 0), (1004, rows[0][1], 1), (1005, [None] * 64, 0), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [1e300, 2e300], 0)]
    got = {r.vec_id: r for r in embedding_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in usable}
    links = [(a, b) for n, a in enumerate(unit) for b in list(unit)[:n] if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    degree = Counter(x for e in links for x in e)
    found = sum(got[i].n_links for i in unit)
    assert found >= 0.98 * 2 * len(links) and all(r.n_links <= degree[r.vec_id] for r in got.values())
    wanted = components_of([i for i, _, _ in rows], links)
    assert sum(got[i].component_id == wanted[i] for i in wanted) >= 0.98 * len(wanted)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embedding_dedup.embedding_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_line_dedup(spark):
    shared, rare = "This line is shared by many documents, really.", "This one is held by only four documents, really."
    texts = [f"{shared}\nown {i}\n  {shared.upper()} \t" + (f"\n{rare}" if i < 4 else "") for i in range(6)] + [None, "", "short\nshort", shared + "\n" + shared]
    docs = documents(spark, texts)
    got = {r[0]: tuple(r[1:]) for r in line_dedup.line_digests(docs).collect()}
    digest = lambda t: sha256(t.encode()).hexdigest()
    for i in range(6):
        assert got[i] == (4 if i < 4 else 3, 2, digest(f"own {i}" + (f"\n{rare}" if i < 4 else "")))
    assert got[6] == got[7] == (1, 0, digest(""))
    assert got[8] == (2, 0, digest("short\nshort")) and got[9] == (2, 0, digest(texts[9]))
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert kept[5] == "own 5" and kept[6] is None and kept[9] == texts[9]
    assert line_dedup.drop_lines(docs).columns == docs.columns
    assert line_dedup.line_digests(documents(spark, [])).count() == 0


def brute_sets(texts, k=5):
    words = [(t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() for t in texts]
    return [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, share):
    """A copy with about this share of words replaced, each costing five shingles."""
    out = list(words)
    for i in np.flatnonzero(rng.random(len(out)) < share):
        out[i] = f"e{rng.integers(10**9)}"
    return out


def test_similar_documents_are_those_of_exact_jaccard(spark):
    rng = np.random.default_rng(21)
    texts = [None, "", " ", "one", "a b c d e f g h", "a b c d e f g h i", "ab " * 500, "ab " * 90, "A b c d e f g h i"]
    for n in (9, 12, 30, 60, 150, 400, 400, 400):
        for _ in range(12):
            base = [f"t{x}" for x in rng.integers(0, 10**6, n)]
            texts += [" ".join(base), *[" ".join(edited(rng, base, s)) for s in (0.01, 0.02, 0.025, 0.04)], " ".join(base + [f"m{x}" for x in rng.integers(0, 10**6, n // 5)])]
    sets = brute_sets(texts)
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(sets[i], sets[j]) >= 0.8]
    close = [(i, j) for i, j in links if jaccard(sets[i], sets[j]) < 0.85]
    assert len(close) > 100
    got = dict(simhash.similar_documents(documents(spark, texts)).select("doc_id", "component_id").collect())
    assert got == components_of(range(len(texts)), links)


def test_verified_roots_connect_like_brute_force():
    rng = np.random.default_rng(22)
    sets = [np.zeros(0, np.uint64), np.array([5], np.uint64)]
    for _ in range(30):
        base = rng.integers(0, 1 << 62, int(rng.integers(1, 60)), dtype=np.uint64)
        sets += [np.unique(np.r_[base[rng.random(len(base)) < s], rng.integers(0, 1 << 62, int(rng.integers(0, 3)), dtype=np.uint64)]) for s in (1, 0.97, 0.93, 0.9)]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i]) and len(sets[j]) and jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8]
    wanted = components_of(range(len(sets)), links)
    assert simhash.verified_roots(sets, 0.8).tolist() == [wanted[i] for i in range(len(sets))]


def brute_lines(rows, min_chars, min_docs):
    """(doc_id, n_lines, n_dropped, digest) of each row; null ids are documents told apart by text, below any id and in the order of xxhash64."""
    strip = " \t\n\x0b\x0c\r"

    def document(i, t):
        signed = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return (i is not None, i or 0, 0 if i is not None else signed - (1 << 64) * (signed >> 63))

    keys = [[line.strip(strip).translate({c: c + 32 for c in range(65, 91)}) for line in (t or "").split("\n")] for _, t in rows]
    holders = {}
    for (i, t), own in zip(rows, keys, strict=True):
        for k in own:
            if len(k) >= min_chars:
                holders.setdefault(k, set()).add(document(i, t))
    out = []
    for (i, t), own in zip(rows, keys, strict=True):
        gone = [k in holders and len(holders[k]) >= min_docs and max(holders[k]) != document(i, t) for k in own]
        kept = "\n".join(line for line, g in zip((t or "").split("\n"), gone, strict=True) if not g)
        out.append((i, len(own), sum(gone), sha256(kept.encode()).hexdigest()))
    return out


def many_ids(seed=31, n=5000):
    """A third of the rows without an id, a third with one id, texts that share lines and passages, and rows repeated whole."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    passages = [" ".join(rng.choice(words, 20)) for _ in range(60)]
    rows = []
    for j in range(n):
        lines = [" ".join(rng.choice(words, 12)), passages[int(rng.integers(60))] if j % 4 == 0 else f"own {j}", " ".join(rng.choice(words, 3))]
        rows.append((None if j % 3 == 0 else 7 if j % 3 == 1 else j, "\n".join(lines)))
    rows += rows[:40] + [(None, None), (None, ""), (7, None), (None, passages[0]), (None, passages[0].upper())]
    return rows


def test_null_and_clashing_ids_are_told_apart_by_text(spark):
    rows = many_ids()
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    texts = [t for _, t in rows]
    own = lambda brute: sorted(((i, *b) for (i, _), b in zip(rows, brute, strict=True)), key=str)
    assert rows_by_id(substring_dedup.substring_digests(docs, 12)) == own(brute_words(texts, 12))
    assert rows_by_id(suffix_dedup.suffix_digests(docs, 70)) == own(brute_bytes(texts, 70))
    assert rows_by_id(line_dedup.line_digests(docs, 40, 5)) == sorted(brute_lines(rows, 40, 5), key=str)


def test_lines_without_an_id_have_one_holder(spark):
    line = "a line of over forty characters that many documents hold"
    rows = [(None, f"{line}\nown {i}") for i in range(30)] + [(None, f"other {line}\n{i}") for i in range(4)] + [(3, f"and {line}\n{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_by_id(line_dedup.line_digests(docs))
    assert got == sorted(brute_lines(rows, 40, 5), key=str)
    assert Counter(r[2] for r in got) == {1: 29, 0: 14}


def test_hot_lines_over_many_ranges(spark):
    """A line that nearly all documents hold begins in one range and goes on through others."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = [f"line {k} is held by a great many of the documents" for k in range(3)]
        rows = [(i if i % 5 else None, "\n".join([lines[0], f"own {i}"] + [x for k, x in enumerate(lines[1:]) if i % (k + 2)])) for i in range(700)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
        assert rows_by_id(line_dedup.line_digests(docs)) == sorted(brute_lines(rows, 40, 5), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_planted_embedding_links(spark):
    """Pairs at cosines of 0.95 to 1 in pairs, chains and one large group, against brute force."""
    rng = np.random.default_rng(41)
    unit = lambda x: x / np.linalg.norm(x)
    vectors = [unit(rng.normal(size=64)) for _ in range(1500)]

    def at_cosine(v, c):
        w = rng.normal(size=64)
        w = unit(w - (w @ v) * v)
        return c * v + np.sqrt(1 - c * c) * w

    for i in range(300):
        vectors.append(at_cosine(vectors[i], rng.uniform(0.94, 1)))
    for _ in range(40):
        vectors.append(at_cosine(vectors[-1], 0.96))
    vectors += [at_cosine(vectors[0], rng.uniform(0.97, 1)) for _ in range(300)]
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[j].tolist()) for i, j in enumerate(order)] + [(5, vectors[3].tolist()), (None, vectors[order[8]].tolist())]
    got = embedding_dedup.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()
    x = np.array([unit(np.array(v)) for _, v in rows])
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    links = Counter(near.ravel().tolist())
    root = components_of(range(len(rows)), [(int(a), int(b)) for a, b in near])
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root[n]] = min(i, least.get(root[n], i))
    wanted = Counter((i, links[n], least[root[n]] if i is not None else None) for n, (i, _) in enumerate(rows))
    found = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert len(got) == len(rows) and sum((wanted & found).values()) >= 0.99 * len(rows)
    assert sum(r.n_links for r in got) >= 0.999 * 2 * len(near)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def covered_by_repeats(texts, window):
    """Bytes of each text in a window that starts at two places or more, by sorting a hash of every window."""
    data = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b"".join(data), np.uint8)
    borders = np.r_[0, np.cumsum([len(b) for b in data])]
    step, odd = 1 << 20, 0xD6E8FEB86659FD93
    up = np.cumprod(np.r_[np.uint64(1), np.full(step + window, odd, np.uint64)], dtype=np.uint64)
    down = np.cumprod(np.r_[np.uint64(1), np.full(step + window, pow(odd, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    h = np.empty(max(0, len(flat) - window + 1), np.uint64)
    for at in range(0, len(h), step):
        piece = flat[at : at + step + window - 1].astype(np.uint64) + np.uint64(1)
        sums = np.r_[np.uint64(0), np.cumsum(piece * up[: len(piece)], dtype=np.uint64)]
        n = len(piece) - window + 1
        x = (sums[window:] - sums[:n]) * down[:n]
        h[at : at + n] = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    row = np.repeat(np.arange(len(data)), np.diff(borders))
    inside = np.flatnonzero(row[: len(h)] == row[window - 1 :])
    _, name, times = np.unique(h[inside], return_inverse=True, return_counts=True)
    at = inside[times[name] > 1]
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    gone = np.cumsum(change[:-1]) > 0
    return [gone[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)], data


def test_suffix_dedup_on_ten_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == 10_000
    gone, data = covered_by_repeats([r.text for r in rows], 400)
    got = {r.doc_id: r for r in suffix_dedup.suffix_digests(docs).collect()}
    for r, g, b in zip(rows, gone, data, strict=True):
        own = got[r.doc_id]
        spans = int(np.count_nonzero(np.diff(np.r_[False, g].astype(np.int8)) == 1))
        assert (own.n_bytes, own.n_removed, own.n_spans) == (len(b), int(g.sum()), spans)
        assert own.kept_sha256 == sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()


def test_components_where_one_id_has_several_texts(spark):
    """Rows are known by their fingerprints: an id that two texts share joins nothing."""
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(500)]
    fresh = lambda n: list(rng.choice(vocabulary, n))
    prints = {}

    def text(words):
        t = " ".join(words)
        prints[t] = int(simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3))[0])
        return t

    x, y = text(x_words := fresh(400)), text(fresh(400))
    z = next(t for k in range(1, 40) if 0 < (prints[x] ^ prints[t := text(x_words[:-k])]).bit_count() <= 3)
    assert 3 < (prints[x] ^ prints[y]).bit_count()
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark, [x, x, y, y, z], [5, 9, 5, 7, 2])).collect()}
    assert got == {(5, 2), (9, 2), (2, 2), (5, 5), (7, 5)}

    texts, ids = [], []
    for _ in range(40):
        base = fresh(300)
        for k in range(int(rng.integers(1, 4))):
            texts.append(text(base[: len(base) - k]))
            ids.append(int(rng.integers(0, 30)))
    rows = [(i, prints[t]) for i, t in zip(ids, texts, strict=True)]
    links = [(a, b) for b in range(len(rows)) for a in range(b) if (rows[a][1] ^ rows[b][1]).bit_count() <= 3]
    root = components_of(range(len(rows)), links)
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root[n]] = min(i, least.get(root[n], i))
    got = sorted((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(documents(spark, texts, ids)).collect())
    assert got == sorted((i, p, least[root[n]]) for n, (i, p) in enumerate(rows))


def test_wide_fingerprints_are_pruned_by_all_their_words():
    """Groups of copies are told apart by the bits that their members share in every word, with the same links."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (6, 8), dtype=np.uint64)
    rows = np.repeat(base, 80, axis=0)
    for r in rows:
        r[rng.integers(0, 8)] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
    rows[:, 0] = rows[0, 0]  # the first word, by which they are sorted, says nothing
    rows = rows[rng.permutation(len(rows))]
    side = np.full(len(rows), 2)
    root = simhash.linked(rows[:, 0], rows[:, 1:], side, 20)
    wanted = components_of(range(len(rows)), [(a, b) for b in range(len(rows)) for a in range(b) if np.bitwise_count(rows[a] ^ rows[b]).sum() <= 20])
    assert root.tolist() == [wanted[i] for i in range(len(rows))] and len(set(root.tolist())) == 6


def test_parameters_without_room_are_errors(spark):
    rows = spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 4)], "rep long, unit array<double>")
    with pytest.raises(ValueError, match="tables"):
        embedding_dedup.links(rows, 10**9, 0.9)


def test_columns_with_names_used_inside_change_nothing(spark):
    """Extra columns may have any name, and rows with one id and different texts are documents of their own."""
    texts = hostile(7, 40) + ["a line that is long enough, and in many documents\nown " + str(i) for i in range(9)]
    ids = [i % 30 for i in range(len(texts))]
    plain = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    inside = ["_d", "_t", "_u", "_n", "_b", "h", "g", "s", "p", "n", "pos", "part", "side", "keep", "gone", "holder", "fp", "wide", "rep", "node", "component", "least", "key", "entries"]
    clashing = plain.select("*", *[F.lit("x").alias(c) for c in inside])
    for digests in (line_dedup.line_digests, substring_dedup.substring_digests, suffix_dedup.suffix_digests, lambda d: simhash.near_duplicates(d).drop("wide")):
        assert sorted(map(str, digests(clashing).collect())) == sorted(map(str, digests(plain).collect()))


def test_lines_of_one_id_with_several_texts(spark):
    """Ties over equal ids: documents are counted by id, and each row of the largest id keeps its lines."""
    line = "a line of at least forty characters that documents share"
    rows = [(i, f"{line}\nown {i}") for i in range(6)] + [(5, f"other\n{line}"), (5, f"{line}\nown 5"), (3, f"{line} \n\t{line}")]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(i, 2, 1) for i in range(5)] + [(5, 2, 0)] * 3 + [(3, 2, 2)])
    few = [(i % 4, f"{line}\n{i}") for i in range(9)]  # four ids are too few, whatever their rows
    assert {r.n_dropped for r in line_dedup.line_digests(spark.createDataFrame(few, "doc_id long, text string")).collect()} == {0}
