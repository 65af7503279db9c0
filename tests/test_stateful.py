"""Merged tables, timed state and watched folders over several batches, replays and failures."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.sources import watch
from corvane.streaming import streams, timers, upsert

DAY = datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merging_a_batch_again_changes_nothing(spark, tmp_path):
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), "item long, entity string, version long", ["item"], 8)
    rule = upsert.latest(["item"], "version")
    frame = lambda rows: spark.createDataFrame(rows, "item long, entity string, version long")
    assert table.read().isEmpty() and table.merged() == (-1, {})
    assert table.merge(frame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (None, "n", None), (1, "a", 1)]), 0, rule)
    first = rows_of(table.read())
    assert first == rows_of(frame([(1, "a", 1), (1, "b", 1), (2, "a", 1), (None, "n", None)]))
    assert not table.merge(frame([(9, "z", 9)]), 0, rule) and rows_of(table.read()) == first
    _, before = table.merged()
    assert table.merge(frame([(1, "c", 2), (2, "old", 0)]), 1, rule)
    _, after = table.merged()
    assert sum(after[b] != n for b, n in before.items()) <= 2  # only touched buckets are written
    assert rows_of(table.read()) == rows_of(frame([(1, "c", 2), (2, "a", 1), (None, "n", None)]))
    # a batch that failed before its ledger is written over
    frame([(5, "half", 1)]).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(str(tmp_path / "t/data/batch-2"))
    assert rows_of(table.read()) == rows_of(frame([(1, "c", 2), (2, "a", 1), (None, "n", None)]))
    assert table.merge(frame([(3, "d", 1)]), 2, rule) and table.read().count() == 4
    kept = rows_of(table.read())
    assert table.vacuum() and rows_of(table.read()) == kept and not table.merge(frame([(8, "x", 1)]), 2, rule)
    assert table.merge(frame([]), 3, rule) and rows_of(table.read()) == kept


def test_merged_stream_in_any_order_and_after_a_restart(spark, tmp_path):
    data = [(i % 7, f"e{i % 3}", i // 10) for i in range(100)]
    wanted = {(k, e, v) for k, e, v in data if v == max(x for i, _, x in data if i == k)}
    for name, order in (("up", data), ("down", data[::-1])):
        source = str(tmp_path / name)
        table = upsert.KeyedTable(spark, str(tmp_path / f"{name}-t"), "item long, entity string, version long", ["item"], 4)
        for part in range(4):
            spark.createDataFrame(order[part * 25 : part * 25 + 25], "item long, entity string, version long").coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema("item long, entity string, version long").parquet(source)
            got = upsert.run(stream, table, upsert.latest(["item"], "version"), str(tmp_path / f"{name}-s"))
        assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(wanted) and table.merged()[0] == 3


def test_second_look_at_files(spark, tmp_path):
    schema = "locator string, fingerprint string, modified long, first_seen long, times long, removed boolean"
    table = upsert.KeyedTable(spark, str(tmp_path / "t"), schema, ["locator"], 4)
    look = lambda rows: spark.createDataFrame([(p, f, m, None, None, gone) for p, f, m, gone in rows], schema)
    for n, rows in enumerate([[("/a", "x", 1, False), ("/b", "y", 1, False)], [("/a", "x", 5, False), ("/b", "z", 5, False), ("/b", "q", 4, False)], [("/a", None, 6, True)], [("/a", "x", 7, False)]]):
        for _ in range(2):
            table.merge(look(rows), n, upsert.ingested)
        if n == 2:
            assert {r.locator: r.removed for r in table.read().collect()} == {"/a": True, "/b": False}
    assert rows_of(table.read()) == [("/a", "x", 1, 1, 1, False), ("/b", "z", 5, 1, 2, False)]


def ran(spark, tmp_path, name, batches, schema, make):
    """All rows that a stream gives over several micro-batches."""
    source, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-s")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_answers_are_kept_for_a_while(spark, tmp_path):
    requests = [("s", f"q{(i * 7) % 5}", DAY + timedelta(seconds=40 * i), i) for i in range(60)] + [("t", "q0", DAY, 100), (None, "q1", DAY, 101), ("t", "q0", DAY + timedelta(seconds=900), 102), ("t", "q0", DAY + timedelta(seconds=300), 103), ("t", None, DAY, 104)]
    batches = [requests[:20], requests[20:40], requests[40:]]
    got = ran(spark, tmp_path, "answers", batches, "space string, query string, ts timestamp, id long", lambda s: timers.kept_answers(s, 300, 3, "1 day"))
    wanted = {}
    kept: dict = {}
    for batch in batches:
        for space, query, ts, i in sorted((r for r in batch if r[1]), key=lambda r: (r[2], r[3])):
            own = kept.setdefault(space, {})
            wanted[i] = query in own and (ts - own[query]).total_seconds() <= 300
            if not wanted[i]:
                own.pop(query, None)
                if len(own) >= 3:
                    del own[min(own, key=lambda q: (own[q], q))]
                own[query] = ts
    assert {r.id: r.hit for r in got} == wanted and 0 < sum(wanted.values()) < len(wanted)


def test_subscriptions_run_when_due_and_show_what_is_new(spark, tmp_path):
    hours = [0, 3, 24, 30, 47, 49, 80]
    results = [[("w", DAY + timedelta(hours=h), f"u{(h + k) % 9}") for k in range(3)] for h in hours] + [[("v", DAY, "u0"), ("v", DAY, "u0"), ("v", DAY, None), (None, DAY, "u1"), ("v", None, "u2")]]
    got = ran(spark, tmp_path, "watch", results, "watch string, ts timestamp, url string", lambda s: timers.fresh_results(s, 24, 4))
    wanted, seen, last = [], [], None
    for h, rows in zip(hours, results, strict=False):
        if last is None or h - last >= 24:
            last = h
            for url in sorted(u for _, _, u in rows):
                if url not in seen:
                    seen.append(url)
                    wanted.append(("w", DAY + timedelta(hours=h), url))
            seen = seen[-4:]
    assert rows_of(spark.createDataFrame(got)) == sorted([*wanted, ("v", DAY, "u0"), (None, DAY, "u1")], key=str)


def test_a_folder_over_several_looks(spark, tmp_path):
    folder, state = tmp_path / "watched", str(tmp_path / "state")
    (folder / "sub").mkdir(parents=True)
    (folder / "node_modules").mkdir()
    for name in ("a.txt", "sub/b.txt", "sub/skip.tmp", "node_modules/x.js", "sp ace.txt"):
        (folder / name).write_text("one")
    looks = lambda: watch.FolderWatch(spark, str(folder), state, ["*.tmp"])
    seen = lambda df: {(r.path, r.change) for r in df.collect()}
    assert seen(looks().look()) == {("a.txt", "created"), ("sub/b.txt", "created"), ("sp ace.txt", "created")}
    assert seen(looks().look()) == set()
    (folder / "a.txt").write_text("longer")
    (folder / "sub/b.txt").rename(folder / "c.txt")
    assert seen(looks().look()) == {("a.txt", "changed"), ("sub/b.txt", "removed"), ("c.txt", "created")}
    # a look that failed after it had listed gives the changes of its own list
    watch.listing(spark, str(folder), ["*.tmp"]).write.parquet(f"{state}/lists/look=3")
    (folder / "d.txt").write_text("late")
    assert seen(looks().look()) == set() and seen(looks().look()) == {("d.txt", "created")}
    (folder / "c.txt").unlink()
    looks().look()
    every = streams.settle(looks().stream(), "changes", "append")
    assert every.count() == 3 + 3 + 1 + 1
    last = {(r.path, r.change, r.look) for r in watch.last_event(every).collect()}
    assert last == {("a.txt", "created", 2), ("sp ace.txt", "created", 0), ("d.txt", "created", 4)}


@pytest.mark.parametrize("glob, hit, miss", [("*.tmp", "a/b.tmp", "a.tmpx"), ("sub/?.txt", "sub/a.txt", "sub/ab.txt"), ("[ab]*", "bc", "cb"), ("[!a]x", "bx", "ax"), ("a.b", "a.b", "axb"), ("[", "[", "x")])
def test_glob_patterns(glob, hit, miss):
    import re

    assert re.match(watch.glob_pattern(glob), hit) and not re.match(watch.glob_pattern(glob), miss)
