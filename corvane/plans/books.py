"""Queries on the library's books, its graph, and what happens over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import graph, library
from corvane.plans import views as V
from corvane.plans.register import registry
from corvane.plans.views import CHUNKS, ITEMS, MENTIONS, OPENS

QUERIES, ORACLE_SQL, query = registry()
_STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'ready' END"


def _status(items):
    return items.withColumn("status", F.when(F.col("item_id") % 17 == 0, "failed").when(F.col("item_id") % 5 == 0, "partial").otherwise("ready"))


@query(f"""WITH {CHUNKS} SELECT count(*) AS items, sum(n_chars)::BIGINT AS bytes, count(*) FILTER ({_STATUS} = 'failed') AS failed, count(*) FILTER ({_STATUS} = 'ready') AS ready,
  (SELECT count(*) FROM chunks) AS chunks FROM documents""")
def library_stats(spark, sf_dir):
    s = library.stats(_status(V.items(spark, sf_dir)), V.chunks(spark, sf_dir))
    return s.select("items", "bytes", F.col("by_status")["failed"].alias("failed"), F.col("by_status")["ready"].alias("ready"), "chunks")


@query(f"""WITH {ITEMS}, b AS (SELECT strftime(content_time, '%Y-W') || strftime(content_time, '%W') AS bucket, modality FROM items)
SELECT bucket, count(*) AS n, count(*) FILTER (modality = 'en') AS en, count(*) FILTER (modality = 'fr') AS fr FROM b GROUP BY bucket ORDER BY bucket DESC LIMIT 60""")
def timeline_buckets(spark, sf_dir):
    t = library.timeline(V.items(spark, sf_dir), "week", 60)
    return t.select("bucket", "n", F.coalesce(F.col("by_modality")["en"], F.lit(0)).alias("en"), F.coalesce(F.col("by_modality")["fr"], F.lit(0)).alias("fr"))


_RISING = f"""{MENTIONS}, counts AS (
  SELECT entity, count(*) FILTER (content_time >= TIMESTAMP '1999-01-01' AND content_time < TIMESTAMP '2000-01-01') AS now,
    count(*) FILTER (content_time >= TIMESTAMP '1998-01-01' AND content_time < TIMESTAMP '1999-01-01') AS before FROM mentions GROUP BY entity),
lifted AS (SELECT *, round(now / (before + 1)::DOUBLE, 6) AS lift FROM counts WHERE now >= 2),
rising AS (SELECT *, row_number() OVER (ORDER BY lift DESC, now DESC, entity) AS rank FROM lifted QUALIFY rank <= 1000)"""


def _rising(spark, sf_dir):
    return graph.rising(V.mentions(spark, sf_dir), "1999-01-01", "1998-01-01", "2000-01-01")


@query(f"WITH {_RISING} SELECT entity, now, before, lift, rank FROM rising")
def rising_entities(spark, sf_dir):
    return _rising(spark, sf_dir)


@query(f"""WITH {ITEMS}, {OPENS}, {CHUNKS}, {_RISING}, sized AS (SELECT item_id, count(*) AS n_chunks FROM chunks GROUP BY item_id),
own AS (SELECT i.item_id, content_time, coalesce(opens, 0) AS opens, last_opened_at, coalesce(n_chunks, 0) AS n_chunks, CASE WHEN i.item_id % 17 = 0 THEN 'failed' WHEN i.item_id % 5 = 0 THEN 'partial' ELSE 'ready' END AS status,
  (epoch(TIMESTAMP '2024-01-25') - epoch(content_time)) / 86400 AS age, (epoch(TIMESTAMP '2024-01-25') - epoch(last_opened_at)) / 86400 AS idle FROM items i LEFT JOIN opens USING (item_id) LEFT JOIN sized USING (item_id)),
hits AS (
  SELECT 'fresh' AS section, item_id, row_number() OVER (ORDER BY content_time DESC, item_id) AS rank FROM own WHERE age BETWEEN 0 AND 1
  UNION ALL SELECT 'revisit', item_id, row_number() OVER (ORDER BY opens DESC, item_id) FROM own WHERE opens >= 3 AND idle > 14
  UNION ALL SELECT 'stuck', item_id, row_number() OVER (ORDER BY content_time DESC, item_id) FROM own WHERE status = 'failed'
  UNION ALL SELECT 'thin', item_id, row_number() OVER (ORDER BY n_chunks, item_id) FROM own WHERE n_chunks <= 1
  UNION ALL SELECT 'rising', entity, rank FROM rising)
SELECT section, rank, item_id, total FROM (SELECT *, count(*) OVER (PARTITION BY section) AS total FROM hits) WHERE rank <= 8""")
def daily_briefing(spark, sf_dir):
    """Without the sleeping section, whose order is that of a hash; ``daily_briefing_asleep`` has it."""
    return library.briefing(_briefed(spark, sf_dir), _rising(spark, sf_dir), "2024-01-25 00:00:00").where("section <> 'asleep'")


@query(f"""WITH {ITEMS}, {OPENS}, own AS (SELECT i.item_id, (epoch(TIMESTAMP '2024-01-25') - epoch(content_time)) / 86400 AS age, coalesce(opens, 0) AS opens FROM items i LEFT JOIN opens USING (item_id)),
hits AS (SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) AS rank, count(*) OVER () AS total FROM own WHERE age > 20 AND opens = 0) SELECT 'asleep' AS section, rank, item_id, total FROM hits WHERE rank <= 8""")
def daily_briefing_asleep(spark, sf_dir):
    return library.briefing(_briefed(spark, sf_dir), _rising(spark, sf_dir), "2024-01-25 00:00:00").where("section = 'asleep'")


def _briefed(spark, sf_dir):
    sized = V.chunks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    i = _status(V.items(spark, sf_dir)).join(V.opens(spark, sf_dir), "item_id", "left").join(sized, "item_id", "left")
    return i.withColumn("opens", F.coalesce("opens", F.lit(0))).withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


@query(f"""WITH {ITEMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY size_bytes * (1 + item_id % 3) DESC, item_id) AS r FROM items)
SELECT fingerprint, count(*) AS copies, min(item_id) FILTER (r = 1) AS best, sum(CASE WHEN r > 1 THEN size_bytes ELSE 0 END)::BIGINT AS wasted_bytes FROM ranked GROUP BY fingerprint HAVING count(*) >= 2""")
def duplicate_sweep(spark, sf_dir):
    return library.duplicate_sweep(V.items(spark, sf_dir), "fingerprint", F.col("size_bytes") * (1 + F.col("item_id") % 3))


@query(f"WITH {ITEMS} SELECT fingerprint, min(item_id) AS item_id, count(*) - 1 AS skipped FROM items GROUP BY fingerprint")
def content_dedupe(spark, sf_dir):
    return V.items(spark, sf_dir).groupBy("fingerprint").agg(F.min("item_id").alias("item_id"), (F.count(F.lit(1)) - 1).alias("skipped"))


_FEW = """few AS (SELECT item, entity FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY entity) AS r FROM (SELECT DISTINCT item, entity FROM mentions)) WHERE r <= 12),
edges AS (SELECT a.entity AS lo, b.entity AS hi, count(*) AS weight FROM few a JOIN few b ON a.item = b.item AND a.entity < b.entity GROUP BY ALL)"""


@query(f"WITH {MENTIONS}, held AS (SELECT DISTINCT item, entity FROM mentions) SELECT a.entity AS lo, b.entity AS hi, count(*) AS weight FROM held a JOIN held b ON a.item = b.item AND a.entity < b.entity GROUP BY ALL")
def cooccurrence_edges(spark, sf_dir):
    return graph.cooccurrence(V.mentions(spark, sf_dir), tasks=V.mention_tasks(spark, sf_dir))


@query(f"""WITH {MENTIONS}, {_FEW}, near AS (SELECT hi AS n FROM edges WHERE lo = 7 UNION SELECT lo FROM edges WHERE hi = 7 UNION SELECT 7)
SELECT lo, hi, weight FROM edges WHERE lo IN (SELECT n FROM near) AND hi IN (SELECT n FROM near) ORDER BY weight DESC, lo, hi LIMIT 400""")
def graph_slice(spark, sf_dir):
    return graph.ego(graph.cooccurrence(V.mentions(spark, sf_dir), 12, V.mention_tasks(spark, sf_dir)), 7)


_RELATION = f"""{MENTIONS}, own AS (SELECT DISTINCT item, strftime(content_time, '%Y') AS bucket FROM mentions WHERE entity = 7),
counts AS (SELECT bucket, count(DISTINCT item) AS items FROM own GROUP BY bucket),
met AS (SELECT bucket, m.entity AS peer, count(DISTINCT item) AS n FROM own JOIN mentions m USING (item) WHERE m.entity <> 7 GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, peer) AS r FROM met) WHERE r <= 8),
sets AS (SELECT bucket, items, coalesce((SELECT list(peer ORDER BY peer) FROM top t WHERE t.bucket = c.bucket), []) AS peers FROM counts c)"""


@query(f"WITH {_RELATION} SELECT bucket, items, array_to_string(peers, ',') AS peers FROM sets")
def relation_timeline(spark, sf_dir):
    r = graph.relation_timeline(V.mentions(spark, sf_dir), 7, "year")
    return r.select("bucket", "items", F.array_join(F.transform("peers", lambda x: x.cast("string")), ",").alias("peers"))


@query(f"""WITH {_RELATION}, steps AS (SELECT bucket, peers, coalesce(lag(peers) OVER (ORDER BY bucket), []) AS before FROM sets)
SELECT bucket, array_to_string(list_filter(peers, lambda x: NOT list_contains(before, x)), ',') AS appeared, array_to_string(list_filter(before, lambda x: NOT list_contains(peers, x)), ',') AS disappeared FROM steps""")
def relation_changes(spark, sf_dir):
    r = graph.relation_timeline(V.mentions(spark, sf_dir), 7, "year")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return r.select("bucket", text("appeared"), text("disappeared"))


@query("""WITH cites AS (SELECT DISTINCT o_custkey AS seed, l_partkey AS ref FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
counts AS (SELECT ref, count(*) AS seeds FROM cites GROUP BY ref HAVING count(*) >= 2) SELECT ref, seeds, row_number() OVER (ORDER BY seeds DESC, ref) AS rank FROM counts QUALIFY rank <= 100""")
def co_citation(spark, sf_dir):
    li, o = V.table(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "orders")
    return graph.cocitation(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("seed"), F.col("l_partkey").alias("ref")))


_HASH = "(('0x' || md5(split_part(text, ' ', 2))[1:4])::BIGINT * 17592186044416 + ('0x' || md5(split_part(text, ' ', 3))[1:4])::BIGINT * 4294967296 + ('0x' || md5(split_part(text, ' ', 4))[1:4])::BIGINT * 65536 + ('0x' || md5(split_part(text, ' ', 5))[1:4])::BIGINT)"


@query(f"""WITH hashed AS (SELECT doc_id AS item_id, {_HASH} AS hash FROM documents), classes AS (SELECT hash, min(item_id) AS item_id FROM hashed GROUP BY hash)
SELECT x.item_id AS a, y.item_id AS b, bit_count(xor(x.hash, y.hash))::BIGINT AS distance FROM classes x JOIN classes y ON x.item_id < y.item_id AND bit_count(xor(x.hash, y.hash)) <= 10
UNION ALL SELECT c.item_id, h.item_id, 0 FROM hashed h JOIN classes c USING (hash) WHERE c.item_id < h.item_id""")
def band_near_dup(spark, sf_dir):
    """Perceptual hashes stand in as four 16-bit digests of words, so that near ones share segments."""
    part = lambda n: F.conv(F.substring(F.md5(F.coalesce(F.get(F.split("text", " "), F.lit(n)), F.lit(""))), 1, 4), 16, 10).cast("long")
    h = part(1) * F.lit(17592186044416) + part(2) * F.lit(4294967296) + part(3) * 65536 + part(4)
    return graph.near_pairs(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), h.alias("hash")))


_LOG = """log AS (SELECT event_id AS seq, ts, 'e' || user_id % 12 AS engine, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'empty' WHEN 'signup' THEN 'challenged' WHEN 'error' THEN 'broken' ELSE 'ok' END AS outcome, value * 30 AS elapsed_ms FROM events)"""


def _log(spark, sf_dir):
    t = F.col("event_type")
    outcome = F.when(t == "view", "ok").when(t == "click", "empty").when(t == "signup", "challenged").when(t == "error", "broken").otherwise("ok")
    return V.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts", F.concat(F.lit("e"), (F.col("user_id") % 12).cast("string")).alias("engine"), outcome.alias("outcome"), (F.col("value") * 30).alias("elapsed_ms"))


@query(f"""WITH {_LOG}, recent AS (SELECT *, row_number() OVER (PARTITION BY engine ORDER BY seq DESC) AS back FROM log),
base AS (SELECT engine, avg(CASE outcome WHEN 'ok' THEN 1.0::DOUBLE WHEN 'empty' THEN 0.8::DOUBLE WHEN 'challenged' THEN 0.35::DOUBLE ELSE 0 END) AS base, count(*) AS n FROM recent WHERE back <= 30 GROUP BY engine),
calls AS (SELECT engine, list(elapsed_ms ORDER BY seq) AS ms FROM log WHERE outcome = 'ok' GROUP BY engine),
ewma AS (SELECT engine, list_reduce(ms, lambda a, b: 0.7::DOUBLE * a + 0.3::DOUBLE * b) AS ewma_ms FROM calls)
SELECT engine, round(base * (1 - 0.125::DOUBLE * coalesce(greatest(0, least(2.0::DOUBLE, ewma_ms / 1500 - 1)), 0)), 6) AS score, round(base, 6) AS base, round(ewma_ms, 4) AS ewma_ms, n FROM base LEFT JOIN ewma USING (engine)""")
def engine_health(spark, sf_dir):
    return library.engine_health(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, marked AS (SELECT *, sum(CASE WHEN outcome <> 'broken' THEN 1 ELSE 0 END) OVER (PARTITION BY engine ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS fine FROM log),
numbered AS (SELECT *, row_number() OVER (PARTITION BY engine, fine ORDER BY ts, seq) AS nth FROM marked WHERE outcome = 'broken')
SELECT engine, ts AS opened_at, ts + INTERVAL 900 SECOND AS open_until FROM numbered WHERE nth % 3 = 0""")
def breaker_state(spark, sf_dir):
    return library.breaker(_log(spark, sf_dir))


@query(f"""WITH {_LOG}, tried AS (SELECT engine, count(*) AS calls, max(ts) AS last_tried, count(*) FILTER (outcome = 'ok') / count(*)::DOUBLE AS share FROM log GROUP BY engine),
ranked AS (SELECT *, row_number() OVER (ORDER BY share DESC, engine) AS r FROM tried),
oldest AS (SELECT engine FROM ranked WHERE r > 5 ORDER BY last_tried, engine LIMIT 1)
SELECT engine, CASE WHEN r <= 5 THEN 'best' ELSE 'explore' END AS slot FROM ranked WHERE r <= 5 OR engine IN (SELECT engine FROM oldest)""")
def engine_lineup(spark, sf_dir):
    """The five engines with the best share of ok calls, and the one of the rest that was tried longest ago."""
    t = _log(spark, sf_dir).groupBy("engine").agg(F.max("ts").alias("last_tried"), (F.count_if(F.col("outcome") == "ok") / F.count(F.lit(1))).alias("share"))
    ranked = t.withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("share"), "engine")))
    best = ranked.where("r <= 5").select("engine", F.lit("best").alias("slot"))
    return best.unionAll(ranked.where("r > 5").orderBy("last_tried", "engine").limit(1).select("engine", F.lit("explore")))


@query(f"""WITH {ITEMS}, base AS (SELECT item_id, fingerprint, locator FROM items WHERE item_id % 10 <> 1),
other AS (SELECT CASE WHEN item_id % 10 = 2 THEN item_id + 10000000 ELSE item_id END AS item_id, CASE WHEN item_id % 10 = 3 THEN 'x' || fingerprint ELSE fingerprint END AS fingerprint, locator FROM items WHERE item_id % 10 <> 4),
gone AS (SELECT DISTINCT fingerprint FROM base WHERE item_id NOT IN (SELECT item_id FROM other))
SELECT coalesce(o.item_id, b.item_id) AS item_id, CASE WHEN b.item_id IS NULL THEN CASE WHEN o.fingerprint IN (SELECT fingerprint FROM gone) THEN 'reingested' ELSE 'added' END WHEN o.item_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM base b FULL JOIN other o USING (item_id) WHERE b.item_id IS NULL OR o.item_id IS NULL OR b.fingerprint <> o.fingerprint""")
def snapshot_diff(spark, sf_dir):
    i = V.items(spark, sf_dir).select("item_id", "fingerprint", "locator")
    tail = F.col("item_id") % 10
    other = i.where(tail != 4).select(F.when(tail == 2, F.col("item_id") + 10000000).otherwise(F.col("item_id")).alias("item_id"), F.when(tail == 3, F.concat(F.lit("x"), "fingerprint")).otherwise(F.col("fingerprint")).alias("fingerprint"), "locator")
    return library.snapshot_diff(i.where(tail != 1), other)


@query("""WITH snaps AS (SELECT o_orderkey AS snapshot_id, o_orderdate AS taken_at, o_orderkey % 4 <> 0 AS auto FROM orders)
SELECT snapshot_id, taken_at, auto FROM snaps WHERE NOT auto OR snapshot_id IN (SELECT snapshot_id FROM snaps WHERE auto ORDER BY taken_at DESC, snapshot_id DESC LIMIT 30)""")
def snapshot_prune(spark, sf_dir):
    s = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("taken_at"), (F.col("o_orderkey") % 4 != 0).alias("auto"))
    return library.prune_snapshots(s)


_OPS = "ops AS (SELECT event_id AS op_id, user_id AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 3 AS lamport, 'd' || event_id % 4 AS device, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, props AS payload FROM events)"


@query(f"""WITH {_OPS}, last AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY lamport DESC, device DESC, op_id DESC) AS r FROM ops)
SELECT entity_id, lamport AS clock, lamport, device, CASE WHEN kind <> 'delete' THEN payload END AS payload, kind = 'delete' AS tombstone FROM last WHERE r = 1""")
def lww_merge(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ops = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("op_id"), F.col("user_id").alias("entity_id"), F.floor(nth / 3).alias("lamport"), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("device"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.col("props").alias("payload"))
    return library.last_writer_wins(ops)


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(split_part(url, '#', 1), '^[A-Za-z]+://', ''), '/+$', '') AS address FROM pages),
seen AS (SELECT DISTINCT address FROM p WHERE page_id % 3 = 0) SELECT min(page_id) AS page_id, address FROM p WHERE page_id % 3 <> 0 AND address NOT IN (SELECT address FROM seen) GROUP BY address""")
def watch_fresh(spark, sf_dir):
    """Addresses that a watch hasn't seen: an anti-join with what it has, once each."""
    p = V.table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.substring_index("url", "#", 1), "^[A-Za-z]+://", ""), "/+$", "").alias("address"))
    return p.where("page_id % 3 <> 0").join(p.where("page_id % 3 = 0").select("address").distinct(), "address", "left_anti").groupBy("address").agg(F.min("page_id").alias("page_id"))


@query("SELECT o_orderkey AS item_id, o_orderdate + INTERVAL 30 DAY AS purge_at, o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1998-06-01' AS expired FROM orders WHERE o_orderstatus = 'F'")
def trash_ttl(spark, sf_dir):
    t = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("deleted_at"))
    return library.expired(t, "1998-06-01 00:00:00").select("item_id", "purge_at", "expired")


@query("""SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT event_id % 1000 FROM events WHERE event_type IN ('view', 'click'))""")
def stage_pending(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("item_id"), F.lit("ocr").alias("stage"), F.when(F.col("event_type") == "view", "done").when(F.col("event_type") == "click", "skipped").otherwise("pending").alias("status"))
    return library.pending(V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), e, "ocr")


@query("""SELECT doc_id AS item_id, CASE WHEN doc_id % 11 = 0 THEN 'unverifiable' WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents""")
def evidence_chain(spark, sf_dir):
    i = V.items(spark, sf_dir)
    d = V.table(spark, sf_dir, "documents")
    place = F.concat(F.lit("/"), F.col("doc_id").cast("string"))
    manifest = i.select("item_id", F.concat(F.lit("/"), F.col("item_id").cast("string")).alias("locator"), F.when(F.col("item_id") % 11 != 0, F.col("fingerprint")).alias("digest"))
    found = d.where("doc_id % 7 <> 0").select(place.alias("locator"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")), 256).alias("digest"))
    return library.evidence_chain(manifest, found)


@query("""WITH e AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, event_id FROM events),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS opened, max(ts) AS last_at, count(*) AS n, max(event_id) FILTER (ts = last) AS last_event FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, session) AS last FROM marked) GROUP BY user_id, session""")
def debounce_sessions(spark, sf_dir):
    """Bursts of changes to one path, flushed after an hour of silence; the last change wins."""
    e = V.table(spark, sf_dir, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.min("ts").alias("opened"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))
    return s.select("user_id", "opened", "last_at", "n", "last_event")


_SCENES = """scenes AS (SELECT user_id AS video, ts AS start_at, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-03-01') AS end_at, event_id AS scene FROM events WHERE event_type = 'view'),
said AS (SELECT user_id AS video, ts + to_milliseconds(CAST(floor(value * 500) AS BIGINT)) AS mid, event_id AS line FROM events WHERE event_type = 'click')"""


@query(f"WITH {_SCENES} SELECT line, min(scene) AS scene FROM said JOIN scenes USING (video) WHERE start_at <= mid AND mid < end_at GROUP BY line")
def scene_interval_join(spark, sf_dir):
    """Utterances into the scene that holds their middle: scenes are cut into days, so the join has an equal key."""
    e = V.table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    scenes = e.where("event_type = 'view'").select(F.col("user_id").alias("video"), F.col("ts").alias("start_at"), F.coalesce(F.lead("ts").over(w), F.lit("2024-03-01").cast("timestamp")).alias("end_at"), F.col("event_id").alias("scene"))
    days = scenes.withColumn("day", F.explode(F.sequence(F.to_date("start_at"), F.to_date("end_at"), F.expr("interval 1 day"))))
    said = e.where("event_type = 'click'").select(F.col("user_id").alias("video"), (F.col("ts") + F.make_dt_interval(secs=(F.floor(F.col("value") * 500) / 1000).cast("decimal(18,6)"))).alias("mid"), F.col("event_id").alias("line")).withColumn("day", F.to_date("mid"))
    return said.join(days, ["video", "day"]).where("start_at <= mid AND mid < end_at").groupBy("line").agg(F.min("scene").alias("scene"))


@query("""WITH said AS (SELECT user_id AS video, event_id, epoch(ts) / 3600 AS start_h, (epoch(ts) + value) / 3600 AS end_h, ts FROM events),
cut AS (SELECT *, CASE WHEN start_h - lag(end_h) OVER w >= 12 OR lag(end_h) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM said WINDOW w AS (PARTITION BY video ORDER BY ts, event_id)),
chapters AS (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS chapter FROM cut)
SELECT video, chapter, count(*) AS lines, min(ts) AS start_at FROM chapters GROUP BY video, chapter""")
def pause_chapters(spark, sf_dir):
    """A chapter begins after a pause of twelve hours."""
    w = Window.partitionBy("video").orderBy("ts", "event_id")
    s = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("start_h"), ((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("value")) / 3600).alias("end_h"))
    cut = s.withColumn("fresh", F.when(F.lag("end_h").over(w).isNull() | (F.col("start_h") - F.lag("end_h").over(w) >= 12), 1).otherwise(0))
    c = cut.withColumn("chapter", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("video", "chapter").agg(F.count(F.lit(1)).alias("lines"), F.min("ts").alias("start_at"))


@query("""WITH cites AS (SELECT DISTINCT p_brand AS topic, l_partkey AS seed, -1 - o_custkey AS paper FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
cited AS (SELECT -1 - o_custkey AS paper, count(*) AS citations FROM orders GROUP BY 1), counts AS (SELECT topic, paper, count(*) AS seeds FROM cites GROUP BY ALL)
SELECT topic, paper, seeds, citations, row_number() OVER (PARTITION BY topic ORDER BY seeds DESC, citations DESC, paper) AS rank FROM counts JOIN cited USING (paper) QUALIFY rank <= 20""")
def follow_ups(spark, sf_dir):
    """Customers stand for papers that cite the parts of a brand, and their orders for citations."""
    li, o, p = (V.table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    paper = (-1 - F.col("o_custkey")).alias("paper")
    cites = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("topic"), F.col("l_partkey").alias("seed"), paper)
    return graph.followups(cites, o.groupBy(paper).agg(F.count(F.lit(1)).alias("citations")))
