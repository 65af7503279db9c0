"""Queries that run a stream over all that is there; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans.register import registry
from corvane.streaming import streams as S
from corvane.streaming import timers, upsert
from corvane.tables import fresh_path

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT event_type AS term, event_id % 500 AS item_id, count(*) AS n, max(ts) AS at FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def stream_click_counts(spark, sf_dir):
    e = S.stream(spark, f"{sf_dir}/events.parquet").where(F.col("event_type").isin("click", "view"))
    return S.settle(S.click_counts(e.select(F.col("event_type").alias("term"), (F.col("event_id") % 500).alias("item_id"), "ts")), "clicks")


@query("""WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id AS path, min(ts) AS opened, max(ts) AS last_at, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last_id FROM marked GROUP BY user_id, session""")
def stream_debounce(spark, sf_dir):
    e = S.stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    out = S.settle(S.debounced(e, "1 hour", "40 days"), "debounce")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "last_at")})


@query("""SELECT user_id AS entity_id, event_id // 3 AS lamport, 'd' || event_id % 4 AS device, event_id AS op_id, props AS payload FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id // 3 DESC, 'd' || event_id % 4 DESC, event_id DESC) = 1""")
def stream_lww(spark, sf_dir):
    e = S.stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("entity_id"), F.floor(F.col("event_id") / 3).alias("lamport"), F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string")).alias("device"), F.col("event_id").alias("op_id"), F.col("props").alias("payload"))
    return S.settle(S.last_writer(e), "writers")


@query("SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark, sf_dir):
    e = S.stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return S.settle(S.windowed_counts(e, "1 day", "40 days"), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    e = S.stream(spark, f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.settle(S.first_seen(e, "user_id", "40 days").select("user_id"), "seen", "append")


@query()
def stream_running_clusters(spark, sf_dir):
    v = S.stream(spark, f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("space"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return S.settle(S.running_clusters(v), "clusters", "append")


def _mentioned(spark, sf_dir):
    """(item, entity, mention, version): of each user the mentions of their last day, merged from four micro-batches in any order."""
    parts = fresh_path(spark, "event_parts")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(parts)
    e = spark.readStream.schema(spark.read.parquet(parts).schema).option("maxFilesPerTrigger", 1).parquet(parts)
    rows = e.select(F.col("user_id").alias("item"), F.col("event_type").alias("entity"), F.col("event_id").alias("mention"), F.to_date("ts").alias("version"))
    table = upsert.KeyedTable(spark, fresh_path(spark, "mentions"), "item long, entity string, mention long, version date", ["item"])
    return upsert.run(rows, table, upsert.latest(["item"], "version"), fresh_path(spark, "mentions-state"))


_LAST = "WITH days AS (SELECT user_id, max(CAST(ts AS DATE)) AS day FROM events GROUP BY user_id), mentioned AS (SELECT user_id AS item, event_type AS entity FROM events JOIN days USING (user_id) WHERE CAST(ts AS DATE) = day)"


@query(f"{_LAST} SELECT entity, count(DISTINCT item) AS items, count(*) AS mentions FROM mentioned GROUP BY entity")
def stream_entity_upsert(spark, sf_dir):
    return _mentioned(spark, sf_dir).groupBy("entity").agg(F.count_distinct("item").alias("items"), F.count(F.lit(1)).alias("mentions"))


@query(f"{_LAST}, held AS (SELECT DISTINCT item, entity FROM mentioned) SELECT a.entity AS lo, b.entity AS hi, count(*) AS weight FROM held a JOIN held b ON a.item = b.item AND a.entity < b.entity GROUP BY ALL")
def stream_entity_edges(spark, sf_dir):
    return graph.cooccurrence(_mentioned(spark, sf_dir).select("item", "entity").distinct())


@query()
def stream_kept_answers(spark, sf_dir):
    """Which requests find an answer that is no more than ten minutes old; at most two hundred are kept for each type."""
    e = S.stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("space"), F.col("user_id").cast("string").alias("query"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    return S.settle(timers.kept_answers(e, late="40 days"), "answers", "append")


@query("""WITH RECURSIVE results AS (SELECT DISTINCT event_type AS watch, date_trunc('hour', ts) AS h, 'u' || user_id AS url FROM events),
runs AS (SELECT watch, min(h) AS h FROM results GROUP BY watch UNION ALL SELECT r.watch, (SELECT min(x.h) FROM results x WHERE x.watch = r.watch AND x.h >= r.h + INTERVAL 24 HOUR) FROM runs r WHERE r.h IS NOT NULL)
SELECT watch, min(h) AS ran_at, url FROM runs JOIN results USING (watch, h) GROUP BY watch, url""")
def stream_fresh_results(spark, sf_dir):
    """Subscriptions that run once a day: what each run finds that none before it had."""
    e = S.stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("watch"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"))
    return S.settle(timers.fresh_results(e, 24, 1_000_000), "fresh", "append").withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))
