"""Filter audit, conversation repair and licence scans against brute force and SQL, on hostile rows."""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import permutations, product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import conversation_repair as repair
from corvane.llm import filter_audit, license_scan, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, h long, first long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, 0, 9, "clash", 1, 2) for i, t, s in rows], DOCS)


def registered(con, **frames):
    for name, df in frames.items():
        con.register(name, pa.Table.from_pandas(df.toPandas()) if df.isEmpty() else df.toArrow())


def compared(df, con, sql):
    got = con.sql(sql)
    at = [got.columns.index(c) for c in df.columns]
    assert sorted(repr([None if v != v else v for v in r]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in got.fetchall())


def audit_rows(seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)] + ["BIG", "#tag", "é", "x|y"]
    texts = [None, "", " ", "one", "ABC", "w " * 300, "word " * 199 + "$", " ".join(f"v{i}" for i in range(200)), "Ü" * 50]
    for i in range(60):
        texts.append(" ".join(rng.choice(words[: int(rng.choice([40, 400, 404]))], int(rng.integers(1, 420)))))
    rows = [(i, t, [None, "", "a", "b"][i % 4]) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 12], "a") for i in range(40)]  # copies
    rows += [(None, "one", "a"), (None, texts[20], None), (3, "one", "a"), (3, "one", "a"), (1, "w", None), (1, "w", None)]
    return rows


def test_filter_audit_on_hostile_rows(spark):
    rows = audit_rows()
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(0, 1, 0, "x"), (3, 1, 1, "x"), (3, 0, None, "x"), (None, 1, 1, "x"), (11, None, 1, "x"), (120, 1, 0, "x")], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_audit(docs, labels)
    con = duckdb.connect()
    registered(con, documents=docs, labels=labels)
    compared(got, con, queries.OP11_SQL)
    # and one part and order by hand
    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any((t2 or "") == t and i2 is not None and i2 < i for i2, t2, _ in rows)}
    own = [fails(i, t or "") for i, t, s in rows if s == "a"]
    found = {(r.filter_order, r.step): r for r in got.where("part = 'a'").collect()}
    shapley = dict.fromkeys("ABCDE", 0)
    for order in map("".join, permutations("ABCDE")):
        left = own
        for step, f in enumerate(order, 1):
            r, gone = found[order, step], sum(x[f] for x in left)
            left = [x for x in left if not x[f]]
            shapley[f] += gone
            assert (r.kept, r.removed, r.redundant) == (len(left), gone, sum(x[f] for x in own) - gone)
            assert r.unique_fails == sum(x[f] and sum(x.values()) == 1 for x in own)
    assert {f: found[o, 1].shapley for o in ("ABCDE", "BACDE", "CABDE", "DABCE", "EABCD") for f in o[0]} == shapley


def test_filter_audit_of_nothing_and_long_texts(spark):
    assert filter_audit.filter_audit(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    long = "ab cd " * 600_000
    assert list(filter_audit._pieces(long.encode())) and b"".join(filter_audit._pieces(long.encode())) == long.encode()
    assert filter_audit.failures(long.encode()) == 0b0010 and filter_audit.failures(b"x" * 3_000_000) == 0b0001
    masks = filter_audit.document_masks(documents(spark, [(1, long, "s"), (2, long, "s"), (0, None, None)])).collect()
    assert sorted((r.doc_id, r.part, r.mask) for r in masks) == [(0, "", 1), (1, "s", 2), (2, "s", 18)]


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_gray_walk_is_the_sum_of_passing_cells(filters):
    cells = np.random.default_rng(filters).integers(0, 50, (7, 1 << filters, 3))
    alive = filter_audit.survivors(cells, filters)
    for state in range(1 << filters):
        assert (alive[:, state] == cells[:, [m for m in range(1 << filters) if not m & state]].sum(axis=1)).all()


def cheapest(rows):
    """Of all edit lists of a few (initial, fault) rows with up to two insertions a gap, the least (cost, audit)."""
    gaps = ["", *"ua", *map("".join, product("ua", repeat=2))]
    best = None
    for inserts in product(gaps, repeat=len(rows) + 1):
        for edits in product(["K", "Ru", "Ra", "D"], repeat=len(rows)):
            if any(e != "D" and f in (repair.BLANK, repair.DUPLICATE) for e, (_, f) in zip(edits, rows, strict=True)):
                continue
            roles, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * len(inserts[0])
            for e, (initial, fault), more in zip(edits, rows, inserts[1:], strict=True):
                roles += ((initial or "?") if e == "K" else e[1:]) + more  # an empty role is none that can be kept
                audit += e[0] + "I" * len(more)
                cost += {"K": 0, "R": 3, "D": 4}[e[0]] + 3 * (e != "D" and fault == repair.CUT) + 3 * len(more)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def parsed(rows):
    spans = repair.Spans()
    for initial, fault in rows:
        spans.add(repair.row_cell(initial, fault))
    return repair.accepted(spans.cell())


@pytest.mark.parametrize("seed", range(25))
def test_repair_is_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(["s", "u", "a", "x", ""], p=[0.15, 0.35, 0.35, 0.1, 0.05])), int(rng.choice([0, 1, 2, 3], p=[0.5, 0.15, 0.15, 0.2]))) for _ in range(int(rng.integers(0, 4)))]
    assert parsed(rows) == cheapest(rows)


def every_split(cells):
    """The cell of a span by the textbook's table: every span length, start and border."""
    n, table = len(cells), {}
    for i, c in enumerate(cells):
        table[i, i + 1] = c
    for length in range(2, n + 1):
        for lo in range(n - length + 1):
            ways = [repair.combined(table[lo, cut], table[cut, lo + length]) for cut in range(lo + 1, lo + length)]
            table[lo, lo + length] = [min((w[s] for w in ways if w[s] is not None), default=None) for s in range(len(repair.SYMBOLS))]
    return table[0, n]


def test_one_border_gives_what_all_give():
    rng = np.random.default_rng(8)
    for n in (2, 5, 13):
        rows = [(str(rng.choice(list("suax"))), int(rng.integers(0, 4))) for _ in range(n)]
        cells = [repair.row_cell(*r) for r in rows]
        spans = repair.Spans()
        for c in cells:
            spans.add(c)
        assert spans.cell() == every_split(cells)
        run = repair.deleted_cell(n)
        spans = repair.Spans()
        for _ in range(n):
            spans.add(repair.row_cell("u", repair.BLANK))
        assert spans.cell() == run


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", b"k") for r in rows], "conv_id long, turn long, role string, text string, n long, kind string, key binary")


def chats(seed=3):
    rng = np.random.default_rng(seed)
    said = ["Yes.", "No", "Why?", "", " \t", "ok then!", None, "fine.\x0c\x0b", "half", "if", "a;f", "日本。", "x.\n"]
    rows = []
    for conv in range(40):
        for turn in range(int(rng.integers(0, 9))):
            rows.append((conv, None if rng.random() < 0.05 else turn, [None, "system", "user", "user", "assistant", "assistant", "", "tool"][int(rng.integers(0, 8))], said[int(rng.integers(0, len(said)))]))
    rows += [(77, t, ["user", "assistant"][t % 2], f"Turn {t % 150}" + "." * (t % 3 > 0)) for t in range(700)]  # over several partitions
    rows += [(None, 1, "user", "Hm."), (None, None, None, None), (None, 2, "assistant", "Hm?")]
    rows += [(80, 4, "user", "Again.")] * 50 + [(80, 4, "assistant", "Tie."), (80, 9, "assistant", "Tie.")]
    rows += [(90, t, "user", "x") for t in range(300) if repair_drops(90, t)]  # nothing is left
    return rows


def repair_drops(conv, turn):
    import zlib

    return zlib.crc32(f"{conv}:{turn}".encode()) % 20 == 0


def test_conversation_repair_on_hostile_rows(spark):
    table = turns(spark, chats())
    con = duckdb.connect()
    registered(con, conversations=table)
    got = repair.damaged_and_repaired(table)
    compared(got, con, queries.OP12_SQL)
    by_id = {r.conv_id: r for r in got.collect()}
    assert (by_id[90].cost, by_id[90].audit, by_id[90].repaired_sha256) == (0, "", sha256(b"").hexdigest())
    assert by_id[80].audit.count("D") >= 49 and None in by_id and len(by_id[77].audit) >= 600
    assert repair.damaged_and_repaired(turns(spark, [])).count() == 0


def test_repaired_turns_fit_the_grammar():
    roles, texts = ["assistant", "user", "user", "system"], ["A.", "B.", "C.", "D."]
    cost, audit = parsed([(r[0], 0) for r in roles])
    out = repair.repaired_turns(roles, texts, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in audit)
    assert [t for _, t in out if t] == [t for t, e in zip(texts, audit.replace("I", ""), strict=True) if e != "D"]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def license_texts():
    mit, apache = license_scan.TEMPLATES["mit"][1], license_scan.TEMPLATES["apache"][1]
    return [
        None, "", "...", "MIT License", "mit\n\n# license,apache-license; general  PUBLIC license", "the mit licenses; permit license", "general public", "Licensed under CC BY-NC 4.0.",
        "foo bar. " + mit.replace("Software", "Program") + " tail", "// " + apache.replace(" ", "\n// "), mit[:200], "x" * 2_500_000 + " mit license", "mit license " * 3, ("pad é " * 250_000) + "general public license " + "ßß " * 300_000 + "mit license",
        ("of the license and " * 70_000) + "Apache License", "public license mit license general public license apache License",
    ]


def test_license_labels_against_plain_search(spark):
    texts = license_texts()
    docs = documents(spark, [*((i if i else None, t, "s") for i, t in enumerate(texts)), (3, "MIT License", "s")])
    got = license_scan.license_labels(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        words = plain_words(texts[r.doc_id or 0])
        places = [(i, label) for phrase, label in license_scan.PHRASES.items() for n in [len(phrase.split())] for i in range(len(words) - n + 1) if words[i : i + n] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None)), r.doc_id
        base = {x for _, x in places}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
        assert not base or r.score == 1
    labels = {r.doc_id: r.labels for r in got}
    assert labels[7] == "cc-by-nc" and labels[8] == "mit" and "apache" in labels[9] and labels[10] == "" and labels[6] == ""
    assert license_scan.license_labels(documents(spark, [])).count() == 0


def test_whole_corpus_has_the_phrases_that_a_search_finds(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.license_labels(docs).collect()}
    for d in docs.collect():
        words = " ".join(plain_words(d.text))
        assert got[d.doc_id].n_base == sum(len(re.findall(rf"(?<!\S){p}(?!\S)", words)) for p in license_scan.PHRASES)


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_and_places(seed):
    rng = np.random.default_rng(seed)
    letters = [b"a", b"b", b"c"]
    templates = [[letters[i] for i in rng.integers(0, 3, int(rng.integers(1, 10)))] for _ in range(int(rng.integers(1, 5)))]
    own = license_scan.SuffixAutomaton(templates)
    doc = [[*letters, b"d"][i] for i in rng.integers(0, 4, 40)]
    state = n = 0
    for i, w in enumerate(doc, 1):
        state, n = own.step(state, n, own.vocabulary[w]) if w in own.vocabulary else (0, 0)
        holds = lambda k: [[e for e in range(k, len(t) + 1) if t[e - k : e] == doc[i - k : i]] for t in templates]  # noqa: B023, E731
        assert n == max(k for k in range(i + 1) if k == 0 or any(holds(k)))
        assert not n or own.ends[state] == {t: e for t, e in enumerate(holds(n)) if e}
