"""Streams of small groups inside sorted partitions, hot groups cut into pairs of blocks, joins with what was aggregated."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is compared block against block in several tasks.
BLOCK_ROWS = 4096


def paired_blocks(df: DataFrame, key: str, spread: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``part``, a group to compare within, and ``side``: 2 to compare among themselves, 0 to compare with side 1.

    Keys of up to ``block_rows`` rows are one part. Rows of a larger key are dealt by a
    hash of ``spread`` to n blocks; the part (i, j) of blocks i < j holds both, so that every
    pair of rows meets in exactly one part and no task holds over about two blocks.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select(key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_b"))
    dealt = df.join(hot, key, "left").withColumn("_mine", F.when(F.col("_b").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit(7), spread), F.col("_b"))).cast("int"))
    other = F.when(F.col("_b").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_b") - 1))
    out = dealt.withColumn("_other", F.explode(other))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    return out.withColumn("part", F.xxhash64(key, low, high)).withColumn("side", F.when(low == high, 2).when(F.col("_mine") == low, 0).otherwise(1).cast("byte")).drop("_b", "_mine", "_other")


def rejoined(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """Rows with what was aggregated of their keys.

    The join is on a hash of the keys. A join on the keys themselves would run in the stage that
    aggregates, where Spark can't split the partition of a hot key.
    """
    own = groups.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in groups.columns if c not in keys])
    test = F.xxhash64(*keys) == F.xxhash64(*[f"_g{i}" for i in range(len(keys))])
    for i, k in enumerate(keys):
        test = test & (F.col(k) == F.col(f"_g{i}"))
    return rows.join(own, test).drop(*[f"_g{i}" for i in range(len(keys))])


def runs(batches: Iterator[pa.RecordBatch], key: str, target_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of consecutive equal ``key``; groups never straddle two tables."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target_rows:
            continue
        keys = np.asarray(batch.column(key))
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if not cut and (len(held) == 1 or held[-2].column(key)[-1].as_py() == batch.column(key)[0].as_py()):
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held, rows = [batch.slice(cut)], batch.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)
