"""Models by held-out accuracy; decontamination, chat format and mixing by brute force and round trips."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, decontamination, language_id, mixing, toxicity
from corvane.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"
LARGEST = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    """At sf0.1, whose labels have some 340 toxic rows to learn from."""
    labels = spark.read.parquet(f"{LARGEST}/labels.parquet")
    scored = QUERIES["op5_toxicity"](spark, LARGEST)
    held = scored.join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in held if r.toxic]
    wrong = [r.predicted for r in held if not r.toxic]
    assert np.mean(caught) >= 0.5 and np.mean(wrong) <= 0.03 and all(0 <= r.score <= 1 for r in held)


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, "you idiot idiots"), (2, None), (3, ""), (4, "a"), (5, "é" * 4000), (6, "fine words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 6 and got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    none = toxicity.toxicity_scores(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.0}
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0


def test_misspellings_share_n_grams(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    plain = " ".join(f"the {w} of and" for w in ("thing", "onder", "reated") * 6)
    data = [plain, plain + " idiot", plain + " idiottt"]
    raw = np.frombuffer("".join(data).encode(), np.uint8)
    odds = toxicity.log_odds(raw, np.r_[0, np.cumsum([len(d.encode()) for d in data])], *model)
    assert odds[1] > odds[0] and odds[2] > odds[0]


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    got = QUERIES["op6_language_id"](spark, LARGER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.97


def test_code_lengths_match_a_plain_context_tree(spark):
    texts = {"aa": ["abracadabra abra", "cadabra"], "bb": ["zzyzx road", "xyzzy"]}
    docs = spark.createDataFrame([(i * 4, t, k) for k, v in texts.items() for i, t in enumerate(v)] + [(100, None, "aa"), (104, "12", "bb"), (108, "x", None)], "doc_id long, text string, lang string")
    own = docs.where(~toxicity.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    model = language_id.fit(docs)
    for row, lang in enumerate(model.langs):
        follow = [Counter() for _ in range(4)]
        for r in own:
            if r.lang == lang and r.text:
                b = b"   " + r.text.encode()
                for i in range(3, len(b)):
                    for o in range(4):
                        follow[o][b[i - o : i], b[i : i + 1]] += 1

        def bits(context, byte, follow=follow):
            for o in range(3, -1, -1):
                seen = {k[1]: n for k, n in follow[o].items() if k[0] == context[3 - o :]}
                total = sum(seen.values()) + len(seen)
                if byte in seen:
                    return spent - np.log2(seen[byte] / total) if (spent := sum(escapes)) or True else 0
                if seen:
                    escapes.append(-np.log2(len(seen) / total))
            return sum(escapes) + 8

        for probe in (b"abra zyx", b"\xc3\xa9q", b"cad"):
            wanted, text = 0.0, b"   " + probe
            for i in range(3, len(text)):
                escapes = []
                wanted += bits(text[i - 3 : i], text[i : i + 1])
            got = model.code_lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0, row]
            assert got == pytest.approx(wanted, abs=1e-3)
    und = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_predictions(docs).collect()}
    assert und[100] == und[104] == ("und", 0.0)
    assert language_id.language_predictions(docs.where("lang is null")).first().lang_pred == "und"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([3, 5, 9, 20, 40, 60])] + [(6, None), (7, "")]
    docs = []
    for i in range(60):
        own = list(rng.choice(vocabulary, int(rng.integers(0, 200))))
        if i % 2:
            passage = items[i % 6][1].split()
            for _ in range(i % 5):
                passage[int(rng.integers(0, len(passage)))] = "changed"
            at = int(rng.integers(0, len(own) + 1))
            own[at:at] = passage
        docs.append((i, " ".join(own).upper().replace(" ", ", ")))
    docs += [(100, None), (101, ""), (102, " ".join(items[5][1].split()[:55]))]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    wanted = {}
    for d, text in docs:
        w = words(text)
        for t, item in items:
            v = words(item)
            if not v or not w:
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            shingles = lambda x, k=k: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
            a = shingles(v)
            best = max((lambda b: sum((a & b).values()) / max(1, sum((a | b).values())))(shingles(w[i : i + n])) for i in range(len(w) - n + 1))
            if best >= 0.8:
                wanted[d, t] = round(best, 6)
    assert got == pytest.approx(wanted) and len(wanted) > 10


def test_hamming_lists_name_few_pairs_and_miss_none(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(900)], 20)).encode() for _ in range(600)]
    items = decontamination.Items(list(range(600)), texts, decontamination.RADIUS)
    near = items.prints[:200].copy()
    for i in range(200):  # up to the radius from an item
        for bit in rng.choice(64, i % (decontamination.RADIUS + 1), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    asked = np.concatenate([near, rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1000, dtype=np.uint64)])
    wanted = {(w, i) for w in range(1200) for i in np.flatnonzero(np.bitwise_count(items.prints ^ asked[w]) <= decontamination.RADIUS).tolist()}
    w, i = items.candidates(asked, 20)
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == wanted and {(x, x) for x in range(200)} <= wanted
    monkeypatch.setattr(items, "radius", decontamination.RADIUS)
    keys, listed, number = items.lists()
    values = np.concatenate([(b << 16 | decontamination._block(asked[200:], b)) * len(number) + number[20] for b in range(4)])
    named = (np.searchsorted(keys, values, "right") - np.searchsorted(keys, values, "left")).sum()
    assert named < 0.05 * 1000 * 600 and len(listed) == len(keys)


def test_radius_holds_windows_at_the_least_similarity():
    """Items with a few words changed, at a similarity of 0.8 or more: the share within the radius."""
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(2000)]
    found = []
    for _ in range(3000):
        words_ = list(rng.choice(vocabulary, int(rng.integers(15, 64))))
        changed = list(words_)
        for at in rng.integers(0, len(words_), int(rng.integers(1, 3))):
            changed[at] = "changed"
        items = decontamination.Items([0, 1], [" ".join(words_).encode(), " ".join(changed).encode()], decontamination.RADIUS)
        data = np.frombuffer(" ".join(changed).encode(), np.uint8)
        tokens, _ = decontamination._word_tokens(data, np.array([0, len(data)]))
        if items.similarity(decontamination._shingles(tokens, 5), 0) >= 0.8:
            found.append(int(np.bitwise_count(items.prints[0] ^ items.prints[1])) <= decontamination.RADIUS)
    assert len(found) > 300 and np.mean(found) >= 0.98


def test_items_without_id_and_several_blocks(spark, monkeypatch):
    words_ = lambda k: " ".join(f"{k}{i}" for i in range(20))
    docs = spark.createDataFrame([(1, words_("a")), (2, "x " + words_("b")), (3, words_("c") + " " + words_("a"))], "doc_id long, text string")
    items = spark.createDataFrame([(None, words_("a")), (None, words_("z")), (7, words_("b")), (7, words_("c")), (8, None), (None, None)], "item_id long, text string")
    for chars in (decontamination.BLOCK_CHARS, 60):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", chars)
        assert sorted(((r.doc_id, r.item_id, r.similarity) for r in decontamination.contaminated_pairs(docs, items).collect()), key=str) == [(1, None, 1.0), (2, 7, 1.0), (3, 7, 1.0), (3, None, 1.0)]
        got = sorted((r.doc_id, r.contaminated, r.n_items, r.item_ids) for r in decontamination.contamination(docs, items).collect())
        assert got == [(1, True, 1, []), (2, True, 1, [7]), (3, True, 2, [7])]


def test_contamination_has_a_row_for_each_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "A b; c d e f!"), (5, "q")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r.item_ids) for r in decontamination.contamination(docs, items).collect())
    assert got == [(0, False, []), (1, True, [5]), (1, True, [5]), (2, False, [])]
    assert decontamination.contamination(docs, items.where("false")).where("contaminated").count() == 0
    assert decontamination.contamination(docs.where("false"), items).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "c <and>\n</turn>\n \\b \\l"), (1, 0, "user", "a\\"), (1, 1, "user", "<turn user>\nb"), (1, 3, "assistant", None), (1, None, "sys>\ntem<", "first"),
        (2, 0, "assistant", ""), (None, 0, None, "no id"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (4, 0, "user", "é日本" * 5000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_chat(df)
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in out.select("conv_id", chat_format.read_chat(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[conv][0] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv][1] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    assert chat_format.format_chat(df.where("false")).count() == 0


def test_mixing_fills_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", "c", None, "big"][min(4, int(rng.integers(0, 9)))], 1) for i in range(900)] + [(5000, None, "empty", 1), (5000, "x", "a", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-6
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    free = {s: target[s] / w for s, w in zip(["a", "b", "big", "c", "empty", None], [1, 2, 3, 1, 2, 3], strict=True) if target[s] < 3 * sum(r.size for r in got if r.source == s) - 1e-6}
    assert len({round(v, 6) for v in free.values()}) <= 1
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    assert mixing.mix(df.where("false")).count() == 0


def plain_log_odds(text, value, bias):
    """The score word by word: the mean of the n-grams' values, weighted by 1 + ln of the word's count, with neutral words added."""
    words = Counter(re.split(rb"[\x20\x09-\x0d]+", text.translate(toxicity.LOWER.tobytes())))
    words.pop(b"", None)
    total = weight = 0.0
    for word, times in words.items():
        marked = b" " + word + b" "
        grams = [marked[i : i + size] for size in toxicity.SIZES for i in range(len(marked) - size + 1)]
        own = [value[toxicity._grams(np.frombuffer(g, np.uint8), len(g))[0]] for g in grams]
        share = 1 + np.log(times)
        total += share * (np.mean(own) if own else 0.0)
        weight += share
    return bias + total / (weight + toxicity.NEUTRAL)


def test_toxicity_scores_match_a_plain_sum():
    rng = np.random.default_rng(51)
    value = rng.normal(0, 5, toxicity.BUCKETS)
    texts = [b"", b" \n ", b"a", b"You IDIOT you idiot, you", "é日本 x\x0by".encode(), b"word " * 3000, b"z" * 5000] + [b" ".join(bytes(rng.integers(97, 123, int(rng.integers(1, 12))).astype(np.uint8)) for _ in range(200)) for _ in range(5)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    got = toxicity.log_odds(raw, np.r_[0, np.cumsum([len(t) for t in texts])], value, -1.5)
    assert got == pytest.approx([plain_log_odds(t, value, -1.5) for t in texts], abs=1e-9)


def test_training_sample_is_bounded(spark, monkeypatch):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda ids, weights, first, toxic, prior: seen.append((len(ids), len(weights), first[-1], len(toxic))) or (np.zeros(toxicity.BUCKETS), 0.0))
    twice = docs.unionByName(docs.limit(300))
    for most in (50_000, 400_000):
        toxicity.fit(twice, labels, max_entries=most)
    toxicity.fit(docs, labels, max_entries=400_000)
    assert all(n == w == f <= most for (n, w, f, _), most in zip(seen, (50_000, 400_000, 400_000), strict=True))
    assert seen[0][0] < seen[1][0] and seen[1] == seen[2]


def test_what_the_training_task_holds_is_bounded(spark, monkeypatch):
    """Training runs in a task, which takes what the driver lists; the list is bounded and the same when rows are repeated."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    listed, trained = [], []
    take, task = toxicity._taken, toxicity._trained
    monkeypatch.setattr(toxicity, "_taken", lambda *a: listed.append(take(*a)) or listed[-1])
    monkeypatch.setattr(toxicity, "_trained", lambda taken, prior: trained.append(taken) or task(taken, prior))
    for some, most in ((docs, 50_000), (docs.unionByName(docs.limit(300)), 50_000), (docs, 400_000)):
        toxicity.fit(some, labels, max_entries=most)
    held = [sum(n for _, _, n in taken) for taken in listed]
    assert trained == listed and all(0 < n <= most for n, most in zip(held, (50_000, 50_000, 400_000), strict=True))
    assert listed[0] == listed[1] and len(listed[0]) < len(listed[2])


def test_models_with_clashing_columns_and_empty_tables(spark):
    rows = [(i, f"some words of text {i} here", "en" if i % 2 else "de", "s", 0.5, "x", 1) for i in range(40)] + [(None, "no id", "en", "s", 0.5, "x", 1), (50, None, None, None, None, None, None), (51, "", "en", "s", 0.5, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, spoken string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity_scores(docs, labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    kept = toxicity.score(docs, toxicity.fit(docs, labels))
    assert kept.columns == [*docs.columns, "toxicity"]
    spoken = language_id.language_predictions(docs).collect()
    assert len(spoken) == len(rows) and {r.lang_pred for r in spoken if r.doc_id in (50, 51)} == {"und"}
    assert language_id.language_predictions(docs.where("false")).count() == 0
    assert toxicity.toxicity_scores(docs.where("false"), labels).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"\\turn <{i}>\n" * (i % 5)) for i in range(6000)]
    out = chat_format.format_chat(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)).select(chat_format.read_chat(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in out.t] == [(r, x) for _, _, r, x in rows]
    assert out.loss == "".join(x for _, _, r, x in rows if r == "assistant")


def test_mix_without_ids(spark):
    """Rows without an id are spread and counted one by one, and sources meet their targets to the word."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i} " * (1 + i % 9), "abc"[i % 3 if i % 5 else 0]) for i in range(5000)] + [(None, None, "a"), (None, "same text", "b"), (None, "same text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total, level = sum(sizes.values()), None
    weight = dict(zip(sorted(sizes), (1, 2, 3), strict=True))
    open_, left = set(sizes), float(total)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
        left -= sum(3 * sizes[s] for s in over)
    assert target == pytest.approx({s: weight[s] * level if s in open_ else 3 * sizes[s] for s in sizes})
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter((r.doc_id, r.size, r.taken) for r in again)
