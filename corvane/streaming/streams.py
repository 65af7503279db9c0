"""Structured Streaming operators: counters, debounced changes, last writer wins, new addresses, online clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.tables import fresh_path


def stream(spark, path: str) -> DataFrame:
    """A parquet table, a folder or one file, as a stream of its files. As a pattern the path may be a file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def settle(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now, and reads its result: with complete, the last state of the sink."""
    spark = df.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def click_counts(clicks: DataFrame) -> DataFrame:
    """(term, item_id, n, at): how often an item was chosen for a term, and when last."""
    return clicks.groupBy("term", "item_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("at"))


def debounced(changes: DataFrame, gap: str, late: str) -> DataFrame:
    """Changes (path, ts, id) of one path with less than ``gap`` between them are one flush; the last change wins."""
    watched = changes.withWatermark("ts", late)
    s = watched.groupBy("path", F.session_window("ts", gap)).agg(F.min("ts").alias("opened"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"), F.max_by("id", F.struct("ts", "id")).alias("last_id"))
    return s.select("path", "opened", "last_at", "n", "last_id")


def last_writer(ops: DataFrame) -> DataFrame:
    """The winning operation (entity_id, lamport, device, op_id, payload) of each entity."""
    return ops.groupBy("entity_id").agg(F.max_by(F.struct("lamport", "device", "op_id", "payload"), F.struct("lamport", "device", "op_id")).alias("w")).select("entity_id", "w.*")


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events (kind, ts, value) in tumbling windows; what comes later than ``late`` is left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "kind", "n", "total")


def first_seen(rows: DataFrame, key: str, late: str) -> DataFrame:
    """Rows whose key wasn't there before, within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_clusters(points: DataFrame, least_cosine: float = 0.45) -> DataFrame:
    """(space, id, cluster): each vector joins the nearest centroid of its space, or begins a cluster.

    Points are (space, id, vector). A centroid is the running mean of its members, so the outcome depends on
    the order of arrival, which is why it is state of a stream and not an aggregate.
    """

    def assign(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = np.array(state.get[0], dtype=float) if state.exists else np.zeros((0, 0))
        counts, n, rows = list(state.get[1]) if state.exists else [], len(sums), []
        norms = np.linalg.norm(sums, axis=1) if n else np.zeros(0)
        for f in frames:
            for i, v in sorted(zip(f["id"], f["vector"], strict=True), key=lambda x: x[0]):
                v = np.asarray(v, float) / max(1e-12, float(np.linalg.norm(v)))
                near = (sums[:n] @ v) / np.maximum(norms[:n], 1e-12) if n else np.zeros(0)  # all centroids at once
                best = int(np.argmax(near)) if n else -1
                if best < 0 or near[best] < least_cosine:
                    if n == len(sums):  # room for as many again
                        sums = np.concatenate([sums.reshape(n, len(v)), np.zeros((max(8, n), len(v)))])
                        norms = np.concatenate([norms, np.zeros(max(8, n))])
                    best, n = n, n + 1
                    counts.append(0)
                sums[best] += v
                norms[best] = np.linalg.norm(sums[best])
                counts[best] += 1
                rows.append((key[0], i, best))
        state.update((sums[:n].tolist(), counts))
        yield pd.DataFrame(rows, columns=["space", "id", "cluster"])

    return points.groupBy("space").applyInPandasWithState(assign, "space long, id long, cluster long", "sums array<array<double>>, counts array<long>", "append", GroupStateTimeout.NoTimeout)
