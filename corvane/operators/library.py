"""The library's own books: statistics, timelines, briefings, duplicates, snapshots, evidence chains and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stats(items: DataFrame, chunks: DataFrame, by: str = "status") -> DataFrame:
    """One row: items, items by status as a map, chunks and bytes."""
    counts = items.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    one = counts.agg(F.sum("n").alias("items"), F.sum("bytes").alias("bytes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "n")))).alias("by_status"))
    return one.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))


def bucket(ts: Column, unit: str) -> Column:
    """Calendar bucket as text; weeks count from the year's first Monday, earlier days are week 00."""
    if unit == "week":
        week = F.floor((F.dayofyear(ts) - 1 + 7 - F.weekday(ts)) / 7)
        return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return F.date_format(ts, {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit])


def timeline(items: DataFrame, unit: str, limit: int) -> DataFrame:
    """(bucket, n, by_modality) of the last ``limit`` buckets."""
    counts = items.groupBy(bucket(F.col("content_time"), unit).alias("bucket"), "modality").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("modality", "n")))).alias("by_modality"))
    return out.orderBy(F.desc("bucket")).limit(limit)


def briefing(items: DataFrame, rising: DataFrame, as_of: str, each: int = 8) -> DataFrame:
    """(section, rank, item_id, total): fresh, asleep, revisit, stuck and thin items, and rising entities.

    Items carry (item_id, content_time, opens, last_opened_at, status, n_chunks). A section holds
    its first ``each`` rows and how many there are. Sleeping items come in the order of a hash.
    """
    now = F.lit(as_of).cast("timestamp")
    days = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(F.col(c).cast("timestamp"))) / 86400.0
    sections = {
        "fresh": (days("content_time").between(0, 1), [F.desc("content_time")]),
        "asleep": ((days("content_time") > 20) & (F.col("opens") == 0), [F.md5(F.col("item_id").cast("string"))]),
        "revisit": ((F.col("opens") >= 3) & (days("last_opened_at") > 14), [F.desc("opens")]),
        "stuck": (F.col("status") == "failed", [F.desc("content_time")]),
        "thin": (F.col("n_chunks") <= 1, [F.col("n_chunks")]),
    }
    out = None
    for name, (test, order) in sections.items():
        hit = items.where(test)
        top = _ranked(hit, order, each)
        part = top.crossJoin(hit.agg(F.count(F.lit(1)).alias("total"))).select(F.lit(name).alias("section"), "rank", "item_id", "total")
        out = part if out is None else out.unionByName(part)
    more = rising.where(F.col("rank") <= each).select(F.lit("rising").alias("section"), "rank", F.col("entity").alias("item_id")).crossJoin(rising.agg(F.count(F.lit(1)).alias("total")))
    return out.unionByName(more)


def _ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    first = df.orderBy(*order, "item_id").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, "item_id")).cast("long"))


def duplicate_sweep(items: DataFrame, key: str, worth: Column) -> DataFrame:
    """(key, copies, best, wasted_bytes) of keys that two items or more share; the best has the highest worth."""
    w = Window.partitionBy(key).orderBy(worth.desc(), "item_id")
    ranked = items.withColumn("r", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min_by("item_id", "r").alias("best"), F.sum(F.when(F.col("r") > 1, F.col("size_bytes")).otherwise(0)).alias("wasted_bytes")).where("copies >= 2")


def snapshot_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """(item_id, change): added, removed, changed (same locator, other fingerprint) or reingested (same fingerprint, other item)."""
    b = base.select(F.col("item_id").alias("b_id"), F.col("fingerprint").alias("b_fp"), F.col("locator").alias("b_loc"))
    o = other.select("item_id", "fingerprint", "locator")
    both = o.join(b, o["item_id"] == b["b_id"], "full_outer")
    same = F.when(F.col("b_id").isNull(), "added").when(F.col("item_id").isNull(), "removed").when(F.col("fingerprint") != F.col("b_fp"), "changed")
    change = both.select(F.coalesce("item_id", "b_id").alias("item_id"), same.alias("change"), F.coalesce("fingerprint", "b_fp").alias("fp")).where("change is not null")
    gone = b.join(o.select("item_id"), b["b_id"] == F.col("item_id"), "left_anti").select(F.col("b_fp").alias("fp")).distinct().withColumn("again", F.lit(True))
    return change.join(gone, "fp", "left").select("item_id", F.when((F.col("change") == "added") & F.col("again"), "reingested").otherwise(F.col("change")).alias("change"))


def prune_snapshots(snapshots: DataFrame, keep: int = 30) -> DataFrame:
    """Snapshots that stay: all that were asked for, and the newest ``keep`` automatic ones, which each partition cuts to before they meet."""
    newest = snapshots.where(F.col("auto")).orderBy(F.desc("taken_at"), F.desc("snapshot_id")).limit(keep)
    return snapshots.where(~F.col("auto")).unionByName(newest)


def evidence_chain(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, status): unchanged, changed, missing, or unverifiable without a recorded digest."""
    joined = manifest.join(found.select("locator", F.col("digest").alias("now")), "locator", "left")
    status = F.when(F.col("digest").isNull(), "unverifiable").when(F.col("now").isNull(), "missing").when(F.col("now").startswith(F.col("digest")), "unchanged").otherwise("changed")
    return joined.select("item_id", status.alias("status"))


def expired(trash: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Adds purge_at and whether it has passed."""
    return trash.withColumn("purge_at", F.col("deleted_at") + F.make_interval(days=F.lit(days))).withColumn("expired", F.col("purge_at") <= F.lit(as_of).cast("timestamp"))


def pending(items: DataFrame, stages: DataFrame, stage: str) -> DataFrame:
    """Items whose stage never ran or is pending; done and skipped are settled."""
    settled = stages.where((F.col("stage") == stage) & F.col("status").isin("done", "skipped")).select("item_id")
    return items.join(settled, "item_id", "left_anti")


def last_writer_wins(ops: DataFrame) -> DataFrame:
    """The state after all operations (entity_id, lamport, device, kind, payload): the largest (lamport, device) of an entity; removed ones are tombstones."""
    key = F.struct("lamport", "device", "op_id")
    return ops.groupBy("entity_id").agg(F.max("lamport").alias("clock"), F.max_by(F.struct("lamport", "device", "kind", "payload"), key).alias("last")).select("entity_id", "clock", "last.lamport", "last.device", F.when(F.col("last.kind") == "delete", F.lit(None)).otherwise(F.col("last.payload")).alias("payload"), (F.col("last.kind") == "delete").alias("tombstone"))


def pack_islands(pairs: DataFrame, least: int = 2) -> DataFrame:
    """Runs of pairs (a, b, i, j) that go on together in i and j: gaps and islands by i - j and rank."""
    w = Window.partitionBy("a", "b", F.col("i") - F.col("j")).orderBy("i")
    runs = pairs.withColumn("island", F.col("i") - F.row_number().over(w)).groupBy("a", "b", (F.col("i") - F.col("j")).alias("shift"), "island").agg(F.min("i").alias("start"), F.max("i").alias("end"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= least).select("a", "b", "shift", "start", "end", "n")


#: Frames of a run that are compared where two videos meet; only longer runs are put together from their two ends.
_GRAM = 6


def frame_runs(frames: DataFrame) -> DataFrame:
    """(a, b, shift, start, end, n): runs of two frames or more in which two videos look alike, of frames (video, i, look).

    A run holds two alike frames one after the other, so videos meet on the looks of neighbouring
    frames and not on single looks, which a great many frames have. Frames carry the looks around them, so a run is told at its first
    pair and no pair is shuffled; a run of ``_GRAM`` frames or more gives a row at either end, by joins on so many looks.
    """
    w = Window.partitionBy("video").orderBy("i")
    at = lambda d: F.when(F.lead("i", d).over(w) == F.col("i") + d, F.lead("look", d).over(w)) if d > 0 else F.when(F.lag("i", -d).over(w) == F.col("i") + d, F.lag("look", -d).over(w))
    around = frames.select("video", "i", F.col("look").alias("l0"), at(-1).alias("before"), *[at(d).alias(f"l{d}") for d in range(1, _GRAM + 1)]).where("l0 is not null AND l1 is not null")
    x, y = around.hint("merge").alias("x"), around.hint("merge").alias("y")
    same = lambda c: F.coalesce(F.col(f"x.{c}") == F.col(f"y.{c}"), F.lit(False))
    every = lambda names: reduce(lambda p, q: p & q, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in names]) & (F.col("x.video") < F.col("y.video"))
    a, b, shift, i = F.col("x.video").alias("a"), F.col("y.video").alias("b"), (F.col("x.i") - F.col("y.i")).alias("shift"), F.col("x.i").alias("i")

    n = F.lit(_GRAM)
    for d in range(_GRAM - 1, 1, -1):
        n = F.when(same(f"l{d}"), n).otherwise(d)
    short = x.join(y, every(["l0", "l1"]) & ~same("before") & (n < _GRAM)).select(a, b, shift, i.alias("start"), (i + n - 1).alias("end"), n.cast("long").alias("n"))

    full = x.join(y, every([f"l{d}" for d in range(_GRAM)]) & (~same("before") | ~same(f"l{_GRAM}")))
    ends = full.select(a, b, shift, i, F.explode(F.filter(F.array(F.when(~same("before"), F.lit(0)), F.when(~same(f"l{_GRAM}"), F.lit(_GRAM - 1))), lambda e: e.isNotNull())).alias("e"))
    paired = ends.select("a", "b", "shift", (F.col("i") + F.col("e")).alias("i"), (F.col("e") > 0).alias("last")).withColumn("start", F.lag("i").over(Window.partitionBy("a", "b", "shift").orderBy("i")))
    return short.unionAll(paired.where("last").select("a", "b", "shift", "start", F.col("i").alias("end"), (F.col("i") - F.col("start") + 1).alias("n")))


def engine_health(log: DataFrame, window: int = 30, reference_ms: float = 1500.0) -> DataFrame:
    """(engine, score, base, ewma_ms, n) after the whole log (engine, seq, outcome, elapsed_ms).

    The last ``window`` outcomes weigh ok 1, empty 0.8, challenged 0.35, broken 0. Latency is the
    ordered average 0.7 old + 0.3 new of ok calls, and costs up to a quarter of the score.
    """
    weight = F.when(F.col("outcome") == "ok", 1.0).when(F.col("outcome") == "empty", 0.8).when(F.col("outcome") == "challenged", 0.35).otherwise(0.0)
    recent = log.withColumn("back", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("seq")))).where(F.col("back") <= window)
    base = recent.groupBy("engine").agg(F.avg(weight).alias("base"), F.count(F.lit(1)).alias("n"))
    calls = log.where("outcome = 'ok'").withColumn("back", F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("seq"))) - 1)
    first = F.max("back").over(Window.partitionBy("engine"))
    share = F.pow(F.lit(0.7), F.col("back")) * F.when(F.col("back") == first, 1.0).otherwise(0.3)
    ewma = calls.withColumn("share", share).groupBy("engine").agg(F.sum(F.col("share") * F.col("elapsed_ms")).alias("ewma_ms"))
    over = F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("ewma_ms") / reference_ms - 1))
    out = base.join(ewma, "engine", "left").withColumn("score", F.col("base") * (1 - 0.125 * F.coalesce(over, F.lit(0.0))))
    return out.select("engine", F.round("score", 6).alias("score"), F.round("base", 6).alias("base"), F.round("ewma_ms", 4).alias("ewma_ms"), "n")


def breaker(log: DataFrame, strikes: int = 3, seconds: int = 900) -> DataFrame:
    """(engine, opened_at, open_until) of every run of ``strikes`` broken calls in a row."""
    order = Window.partitionBy("engine").orderBy("ts", "seq")
    marked = log.withColumn("fine", F.sum(F.when(F.col("outcome") != "broken", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy("engine", "fine", "outcome").orderBy("ts", "seq"))
    hit = marked.where("outcome = 'broken'").withColumn("nth", nth).where(F.col("nth") % strikes == 0)
    return hit.select("engine", F.col("ts").alias("opened_at"), (F.col("ts") + F.make_interval(secs=F.lit(seconds))).alias("open_until"))
